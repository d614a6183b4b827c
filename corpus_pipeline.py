"""Corpus pipeline: from raw documents to packed training sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor
kept, written as Parquet and read again before the next stage. All but the last
return the columns of `documents`.

1. quality rules: documents that fail the base rules or whose posterior is below one
   half go;
2. SimHash near-duplicates: texts within 3 bits, or with a Jaccard similarity of 0.8 or
   more of their five-word shingles, are one group, of which the document of the least
   id stays;
3. benchmark decontamination: documents that hold 80 % or more of a test item's
   shingles go;
4. PII: personal values become pseudonyms of their format, n_chars follows the text;
5. packing: pieces of documents in sequences of at most 2048 tokens.

Defined cases: null and empty texts fail the quality rules. Null ids pass all stages;
where a group has other ids, a null id goes. Repeated rows are copies, of which one
stays. An empty table stays empty through all stages. Other columns, whatever their
names, are carried to the last stage, which returns the columns of packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm import decontamination, packing, pii, quality, simhash
from chronoline.llm.common import table
from chronoline.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, similarity=simhash.SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(docs)
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else done


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("packing", sequence_packing),
]

# Expectation-maximisation, components and the tokenizer have no SQL form; the stages
# are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each result stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/llm-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
