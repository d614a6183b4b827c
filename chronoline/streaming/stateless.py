"""Cleaning and code lookup of arriving records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from chronoline.operators.clean import clean_records
from chronoline.operators.lookups import map_codes_to_tokens


def clean_stream(records: DataFrame, patients: DataFrame, any_of: Sequence[str],
                 token_map: DataFrame | None = None, width: int = 10,
                 ts: str = "timestamp") -> DataFrame:
    """Same rows as the batch path: drop incomplete records, add ages, look codes up.

    `patients` and `token_map` are static tables.
    """
    cleaned = clean_records(records, patients, any_of, ts=ts)
    if token_map is None:
        return cleaned
    return map_codes_to_tokens(cleaned, token_map, "item_code", width)
