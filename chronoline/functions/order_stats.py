"""Exact order statistics of large groups.

Values are first counted per (group, value), which combines on the map side.
Ranks come from an ordered scan over value pieces, so no task ever holds a
whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.functions import ordered as o


def value_counts(df: DataFrame, keys: Sequence[str], value: str,
                 weight: str | None = None) -> DataFrame:
    """(keys, value, cnt) of the non-null values."""
    w = F.lit(1) if weight is None else F.col(weight)
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys, value)
            .agg(F.sum(w).cast("long").alias("cnt")))


def ranked_values(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add `upto` (rows up to and with this value) and `n` (rows of the group)."""
    return o.ordered_scan(counts, keys, [value], o.number_segment(value), {
        "upto": o.running_sum(F.col("cnt")),
        "n": o.total("sum", F.col("cnt")),
    })


def percentiles(counts: DataFrame, keys: Sequence[str], value: str,
                quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles, one column per entry of `quantiles`."""
    ranked = ranked_values(counts, keys, value)
    first = F.col("upto") - F.col("cnt")
    aggs = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((first <= lo) & (lo < F.col("upto")), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when((first <= hi) & (hi < F.col("upto")), F.col(value))).alias(f"__hi_{name}"),
            F.max(pos - lo).alias(f"__fr_{name}"),
        ]
    picked = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *aggs) if keys else \
        ranked.agg(F.max("n").alias("n"), *aggs)
    cols = [
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__fr_{n}")).alias(n)
        for n in quantiles
    ]
    return picked.select(*keys, "n", *cols)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)
