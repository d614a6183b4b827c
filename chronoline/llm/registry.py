"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoline.llm import (
    alignment, chat, decontamination, licenses, packing, periodic, pii, quality, simhash, substring, toxicity, url_filters, warc,
)
from chronoline.session import apply_defaults

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_url_filters": url_filters.op2_url_filters,
    "op3_packing": packing.op3_packing,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_warc": warc.op5_warc,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_pii": pii.op9_pii,
    "op10_license_scans": licenses.op10_license_scans,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_cross_tokenizer_alignment": alignment.op12_cross_tokenizer_alignment,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLES = {"op1_quality_rules": quality.op1_sql(), "op4_chat_formatting": chat.OP4_SQL, "op7_substring_dedup": substring.OP7_SQL, "op6_decontamination": decontamination.OP6_SQL, "op2_url_filters": url_filters.op2_sql(), "op5_warc": warc.OP5_SQL}


def _with_defaults(fn):
    return lambda spark, sf_dir: fn(apply_defaults(spark), sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    return {name: _with_defaults(fn) for name, fn in QUERIES.items()} | {"pipeline": _with_defaults(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
