"""Partial statistics of separate runs, and their merge.

A run over an increment of records leaves one row for each key: numbers of rows and
values, sum and sum of squares, a map from category to number of rows, and a sketch of
the patients (HyperLogLog). All of these add up, so any choice of runs, days or splits
is merged from the stored rows without reading a record again:

* `merged` sums the rows of stored runs, categories by (key, category) so that a key
  of many categories combines before the shuffle;
* `fold` adds one run to totals, key by key, and refuses a run that is in them.

Counts are exact; the number of distinct patients is the sketch's estimate, with a
standard error of 1.04 / sqrt(2^lg_k), about 1.6 % by default. `count_distinct` over the
records stays the exact way.

Null keys are keys. A null category is not counted in the map, a null value not in the
sums. Empty runs add nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 12
COUNTS = ("n", "n_values", "total", "squares")


def partial_counts(df: DataFrame, keys: Sequence[str], value: str | None = None, category: str | None = None,
                   patient: str = "patient_id", lg_k: int = LG_K) -> DataFrame:
    """(keys, n, n_values, total, squares, categories, patients): one run's row for each key."""
    v = F.lit(None).cast("double") if value is None else F.col(value).cast("double")
    kind = F.lit(None).cast("string") if category is None else F.col(category).cast("string")
    rows = df.select(*keys, kind.alias("__c"), v.alias("__v"), F.col(patient).cast("string").alias("__p"))
    # Condensed by category first; a key's map has one entry for each of its categories.
    fine = rows.groupBy(*keys, "__c").agg(
        F.count(F.lit(1)).alias("n"), F.count("__v").alias("n_values"), F.coalesce(F.sum("__v"), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(F.col("__v") * F.col("__v")), F.lit(0.0)).alias("squares"), F.hll_sketch_agg("__p", lg_k).alias("patients"))
    return _condensed(fine, keys)


def _condensed(fine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of (keys, __c) added up to rows of keys with the map of their categories."""
    entry = F.when(F.col("__c").isNotNull(), F.struct(F.col("__c"), F.col("n")))
    return fine.groupBy(*keys).agg(
        *[F.sum(n).alias(n) for n in COUNTS], F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("categories"),
        F.hll_union_agg("patients").alias("patients"))


def add_run(partials: DataFrame, path: str, run: str) -> None:
    """Store a run's rows under its name; a run that is there already is an error."""
    partials.write.mode("error").parquet(f"{path.rstrip('/')}/run={run}")


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs, with the column `run`."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/run=*")


def merged(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of several runs, or of finer keys, merged to one row for each of `keys`."""
    # A pair of a key and a category is one row of each run; sums and sketch ride on a row of their own.
    counted = partials.select(*keys, F.explode("categories").alias("__c", "__n")).groupBy(*keys, "__c").agg(F.sum("__n").alias("n"))
    sums = partials.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in COUNTS], F.hll_union_agg("patients").alias("patients"))
    none = F.lit(None)
    own = counted.select(*keys, "__c", F.col("n").alias("__n"), *[none.cast("long" if n[0] == "n" else "double").alias(n) for n in COUNTS],
                         none.cast("binary").alias("patients"))
    both = own.unionByName(sums.select(*keys, none.cast("string").alias("__c"), none.cast("long").alias("__n"), *COUNTS, "patients"))
    entry = F.when(F.col("__c").isNotNull(), F.struct("__c", "__n"))
    return both.groupBy(*keys).agg(
        *[F.max(n).alias(n) for n in COUNTS], F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("categories"),
        F.first("patients", ignorenulls=True).alias("patients"))


def totals_of(partials: DataFrame, run: str) -> DataFrame:
    """A first run as totals, which know their runs."""
    return partials.withColumn("runs", F.array(F.lit(run)))


def fold(totals: DataFrame, partials: DataFrame, run: str, keys: Sequence[str]) -> DataFrame:
    """Totals with one more run. A run that a key's totals hold already is an error when they are computed."""
    def both(name: str) -> Column:
        return F.coalesce(F.col(f"__t.{name}"), F.lit(0)) + F.coalesce(F.col(f"__p.{name}"), F.lit(0))

    left = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.struct(*totals.columns).alias("__t"))
    right = partials.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], F.struct(*partials.columns).alias("__p"))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"__k{i}").eqNullSafe(F.col(f"__j{i}"))
    nothing = F.create_map().cast("map<string,bigint>")
    categories = F.map_zip_with(F.coalesce("__t.categories", nothing), F.coalesce("__p.categories", nothing),
                                lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    a, b = F.col("__t.patients"), F.col("__p.patients")
    sketch = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.hll_union(a, b))
    held = F.array_contains(F.col("__t.runs"), run) & F.col("__p").isNotNull()
    runs = F.when(held, F.raise_error(F.lit(f"run {run} is in the totals already"))).otherwise(
        F.when(F.col("__p").isNull(), F.col("__t.runs")).otherwise(F.array_append(F.coalesce("__t.runs", F.array().cast("array<string>")), run)))
    return left.join(right, on, "full").select(
        *[F.when(F.col("__t").isNotNull(), F.col(f"__t.{k}")).otherwise(F.col(f"__p.{k}")).alias(k) for k in keys],
        *[both(n).alias(n) for n in COUNTS], categories.alias("categories"), sketch.alias("patients"), runs.alias("runs"))


def finished(merged_rows: DataFrame) -> DataFrame:
    """Mean, standard deviation (of the population) and the estimated number of patients in place of sums and sketch."""
    mean = F.try_divide("total", "n_values")
    spread = F.try_divide("squares", "n_values") - mean * mean
    return merged_rows.withColumns({
        "mean": mean, "std": F.sqrt(F.greatest(spread, F.lit(0.0))), "n_patients": F.hll_sketch_estimate("patients")}
    ).drop("total", "squares", "patients")
