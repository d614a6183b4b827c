"""Counts and statistics of codes and laboratory values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import order_stats as q
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c

SPLITS = ("train", "validation", "test")
PERIODS = ("train", "test")


def code_counts(df: DataFrame, splits: DataFrame, code: str = "item_code",
                names: DataFrame | None = None) -> DataFrame:
    """Occurrences of each code per split of the patient and period of the record.

    `df` has train_period and test_period; `splits` has (patient_id, split).
    Rows are condensed to (patient, code) before the split join.
    """
    per_patient = (df.filter(F.col(code).isNotNull()).groupBy("patient_id", F.col(code).alias("original_value"))
                   .agg(F.sum("train_period").alias("train"), F.sum("test_period").alias("test")))
    joined = per_patient.join(splits.select("patient_id", "split"), "patient_id", "left")
    aggs = [F.coalesce(F.sum(F.when(F.col("split") == s, F.col(p))), F.lit(0)).cast("long")
            .alias(f"{s}_ID_and_{p}_period") for s in SPLITS for p in PERIODS]
    counted = joined.groupBy("original_value").agg(*aggs)
    if names is not None:
        from chronoline.operators.lookups import map_code_names
        counted = map_code_names(counted, names, "original_value", provisional=True)
    return counted


def with_provisional_code(df: DataFrame, code: str = "item_code") -> DataFrame:
    flagged = F.concat(F.col(code), F.lit(fv.PROVISIONAL_SUFFIX))
    return df.withColumn(code, F.when(F.col("provisional") == 1, flagged).otherwise(F.col(code)))


def nonnumeric_counts(labs: DataFrame) -> DataFrame:
    """Count of each non-numeric value per lab code, among rows without a number."""
    rows = labs.filter(F.col("numeric").isNull() & F.col("nonnumeric").isNotNull())
    return rows.groupBy("item_code", "nonnumeric").agg(F.count(F.lit(1)).alias("count"))


def rank_nonnumeric_tokens(counts: DataFrame) -> DataFrame:
    """Token of each value: preset signs, otherwise `[topN]` by frequency.

    A code with both preset and ranked values gets ranks only.
    """
    keyed = counts.withColumn("__neg", -F.col("count"))
    segment = o.number_segment("__neg")
    preset = c.map_literal("nonnumeric", fv.PRESET_RESULT_TOKENS)
    ranked = o.ordered_scan(keyed, ["item_code"], ["__neg", "nonnumeric"], segment, {
        "__rank": o.row_number(),
        "__preset": o.total("sum", preset.isNotNull().cast("int")),
        "__all": o.total("sum", F.lit(1)),
    })
    pure = F.col("__preset") == F.col("__all")
    top = F.concat(F.lit("[top"), F.col("__rank").cast("string"), F.lit("]"))
    return ranked.withColumn("token", F.when(pure, preset).otherwise(top)).drop(
        "__neg", "__rank", "__preset", "__all")


def nonnumeric_stats(counts: DataFrame) -> DataFrame:
    """Tokens with the number of different tokens per code."""
    tokens = rank_nonnumeric_tokens(counts)
    unique = tokens.groupBy("item_code").agg(F.count_distinct("token").alias("unique_count"))
    return tokens.join(unique, "item_code")


def numeric_value_counts(labs: DataFrame) -> DataFrame:
    """(item_code, unit, value, cnt) with missing units as empty text."""
    rows = labs.select("item_code", F.coalesce("unit", F.lit("")).alias("unit"),
                       F.col("numeric").alias("value"))
    return q.value_counts(rows, ["item_code", "unit"], "value")


def numeric_stats(counts: DataFrame, trim_percent: float = fv.TRIM_PERCENT,
                  trim_min_count: int = fv.TRIM_MIN_COUNT) -> DataFrame:
    """Robust statistics per (code, unit) over values clipped to the outer percentiles.

    Clipping leaves the quartiles as they are (the limits lie outside them), so
    one ordered scan gives limits and quartiles; mean and spread are moments
    around the median, and only the MAD needs a second scan.
    """
    keys = ["item_code", "unit"]
    tail = trim_percent / 100.0
    if tail > 0.25:
        raise ValueError("trimming must stay outside the quartiles")
    marks = q.percentiles(counts, keys, "value", {
        "min": 0.0, "p_lo": tail, "q1": 0.25, "med": 0.5, "q3": 0.75, "p_hi": 1.0 - tail, "max": 1.0})
    trims = F.col("n") >= trim_min_count
    centres = marks.select(
        *keys, F.col("n").alias("count"), "min", "max", "med", (F.col("q3") - F.col("q1")).alias("iqr"),
        F.when(trims, F.col("p_lo")).otherwise(F.col("min")).alias("lower_limit"),
        F.when(trims, F.col("p_hi")).otherwise(F.col("max")).alias("upper_limit"))
    clipped = F.greatest("lower_limit", F.least("upper_limit", "value"))
    centred = (counts.join(centres.select(*keys, "med", "lower_limit", "upper_limit"), keys)
               .select(*keys, "cnt", "med", (clipped - F.col("med")).alias("off")))
    moments = centred.groupBy(*keys).agg(
        F.max("med").alias("__m"), q.weighted_mean(F.col("off"), F.col("cnt")).alias("__o"),
        q.weighted_mean(F.col("off") * F.col("off"), F.col("cnt")).alias("__s"))
    moments = moments.select(
        *keys, (F.col("__m") + F.col("__o")).alias("mean"),
        F.sqrt(F.greatest(F.col("__s") - F.col("__o") * F.col("__o"), F.lit(0.0))).alias("std"))
    deviations = (centred.groupBy(*keys, F.abs("off").alias("dev")).agg(F.sum("cnt").alias("cnt")))
    mad = q.percentiles(deviations, keys, "dev", {"mad": 0.5}).drop("n")
    return (centres.join(moments, keys).join(mad, keys)
            .select(*keys, "count", "mean", "med", "std", "mad", "iqr", "min", "max",
                    "lower_limit", "upper_limit"))


def percentile_values(counts: DataFrame, bins: int = 501, eps: float = fv.LOGIT_EPS,
                      keys: Sequence[str] = ("item_code", "unit"), value: str = "value") -> DataFrame:
    """(keys, n, idx, value): the value at each quantile of the logit grid.

    The rank is the nearest one, halves going to the even rank. Every value
    knows the ranks it covers and inverts the grid to find the few quantiles
    among them, so nothing but the grid itself is emitted.
    """
    ranked = q.ranked_values(counts, keys, value)
    low = math.log(eps / (1 - eps))
    step = -2 * low / (bins - 1)
    top = F.greatest(F.col("n") - 1, F.lit(1))

    def grid_index(rank: Column) -> Column:
        p = rank / top
        inside = (F.log(p / (F.lit(1.0) - p)) - F.lit(low)) / F.lit(step)
        return F.when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(float(bins - 1))).otherwise(inside)

    first = F.col("upto") - F.col("cnt")
    lo = F.greatest(F.lit(0), F.floor(grid_index(first - 0.5)) - 1)
    hi = F.least(F.lit(bins - 1), F.ceil(grid_index(F.col("upto") - 0.5)) + 1)
    whole = F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")
    candidates = F.when(F.col("n") == 1, whole).otherwise(F.sequence(lo, hi))
    rank = F.rint((F.col("n") - 1) * c.logit_quantile(F.col("idx"), bins, eps))
    return (ranked.withColumn("idx", F.explode(candidates))
            .filter((first <= rank) & (rank < F.col("upto")))
            .select(*keys, "n", F.col("idx").cast("int"), value))


def percentile_grid(counts: DataFrame, bins: int = 501, eps: float = fv.LOGIT_EPS) -> DataFrame:
    """(item_code, unit, count, grid) with `bins` values per array."""
    long = percentile_values(counts, bins, eps)
    return long.groupBy("item_code", "unit").agg(
        F.max("n").alias("count"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))),
                    lambda s: s["value"]).alias("grid"))


def dominant_unit(stats: DataFrame) -> DataFrame:
    """The row of the most frequent unit of each code."""
    rest = [n for n in stats.columns if n != "item_code"]
    picked = stats.groupBy("item_code").agg(
        F.min_by(F.struct(*rest), F.struct(-F.col("count"), F.col("unit"))).alias("r"))
    return picked.select("item_code", "r.*")


def dedup_lab_reports(labs: DataFrame, time: str = "age_min", record: str = "unique_record_id"
                      ) -> DataFrame:
    """One row per (patient, time, code): the most common unit or value.

    Expects the counts of `attach_lab_stats`. An aggregate, not a window, so
    many copies of one report combine before the shuffle.
    """
    keys = ["patient_id", time, "item_code"]
    count = F.coalesce("num_count", "nonnum_count", F.lit(-1))
    rest = [n for n in labs.columns if n not in keys]
    picked = labs.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(-count, F.col(record))).alias("r"))
    return picked.select(*keys, "r.*")


def lab_report_spans(labs: DataFrame, time: str = "age_min", record: str = "unique_record_id",
                     available: str = "time_available_min", until: str = "seen_until_min") -> DataFrame:
    """The reports `dedup_lab_reports` picks from those known at any one time, for all times at once.

    A report is picked from when it is known until a better one of its (patient, time, code)
    is; `until` is null for the best. Copies known from the same time combine first, so a
    window holds one row for each time at which reports of one result became known.
    """
    keys = ["patient_id", time, "item_code"]
    count = F.coalesce("num_count", "nonnum_count", F.lit(-1))
    rank = F.struct((-count).alias("n"), F.col(record).alias("id"))
    rest = [n for n in labs.columns if n not in (*keys, available)]
    best = labs.groupBy(*keys, available).agg(
        F.min_by(F.struct(*rest), rank).alias("r"), F.min(rank).alias("__rank"))
    better = Window.partitionBy(*keys).orderBy("__rank", available).rowsBetween(Window.unboundedPreceding, -1)
    spans = best.withColumn(until, F.min(available).over(better))
    return spans.filter(F.col(until).isNull() | (F.greatest(time, available) < F.col(until))).select(
        *keys, available, "r.*", until)


def value_segment(value: Column) -> Column:
    """Piece of a double for look-ups: 64 to a power of two above 2^-20, one for all values nearer to zero."""
    size = F.floor((F.log2(F.greatest(F.abs(value), F.lit(2.0 ** -20))) + 20) * 64)
    return F.when(value < 0, -size).otherwise(size).cast("long")


def grid_intervals(grids: DataFrame) -> DataFrame:
    """(item_code, unit, seg, lower, upper, lower_idx, upper_idx): neighbouring grid values and their first
    index, one row for each piece of the axis between them; after the last value `upper` is null.

    A grid has as many rows as it has bins and pieces from its first to its last value.
    """
    points = grids.select("item_code", F.coalesce("unit", F.lit("")).alias("unit"), F.posexplode("grid").alias("idx", "x"))
    points = points.groupBy("item_code", "unit", "x").agg(F.min("idx").alias("idx"))
    # A grid holds a bounded number of bins.
    w = Window.partitionBy("item_code", "unit").orderBy("x")
    pairs = points.select("item_code", "unit", F.col("x").alias("lower"), F.lead("x").over(w).alias("upper"),
                          F.col("idx").alias("lower_idx"), F.lead("idx").over(w).alias("upper_idx"))
    first, last = value_segment(F.col("lower")), value_segment(F.coalesce("upper", "lower"))
    return pairs.withColumn("seg", F.explode(F.sequence(first, last)))


def nearest_bins(labs: DataFrame, grids: DataFrame, value: str = "numeric", out: str = "bin"
                 ) -> DataFrame:
    """Zero-based grid index of each value; null without a grid for (code, unit).

    A value is moved into the range of its grid and then finds its interval by
    (code, unit, piece of the axis), so a frequent code spreads over its pieces and no
    grid travels with a row. The nearer end of the interval wins, the smaller on ties,
    at its first index.
    """
    own = [F.col("item_code").alias("__c"), F.col("unit").alias("__u")]
    intervals = grid_intervals(grids)
    ends = grids.select(F.col("item_code").alias("__ec"), F.coalesce("unit", F.lit("")).alias("__eu"),
                        F.array_min("grid").alias("__first"), F.array_max("grid").alias("__last"))
    unit = F.coalesce("unit", F.lit(""))
    ranged = labs.drop(out).join(ends, (F.col("item_code") == F.col("__ec")) & (unit == F.col("__eu")), "left")
    x = F.least(F.greatest(F.col(value), F.col("__first")), F.col("__last"))
    # least and greatest skip nulls: a row without value or grid has no place
    placed = ranged.withColumn("__x", F.when(F.col(value).isNotNull() & F.col("__first").isNotNull(), x)
                               ).withColumn("__s", value_segment(F.col("__x")))
    found = placed.join(
        intervals.select(*own, "seg", "lower", "upper", "lower_idx", "upper_idx"),
        (F.col("item_code") == F.col("__c")) & (unit == F.col("__u")) & (F.col("__s") == F.col("seg"))
        & (F.col("lower") <= F.col("__x")) & (F.col("upper").isNull() | (F.col("__x") < F.col("upper"))), "left")
    nearer = F.col("upper").isNull() | (F.col("__x") - F.col("lower") <= F.col("upper") - F.col("__x"))
    return found.withColumn(out, F.when(nearer, F.col("lower_idx")).otherwise(F.col("upper_idx")).cast("int")).drop(
        "__c", "__u", "__ec", "__eu", "__first", "__last", "__x", "__s", "seg", "lower", "upper", "lower_idx", "upper_idx")


def bin_values(rows: DataFrame, grids: DataFrame, index: str = "bin", out: str = "value") -> DataFrame:
    """Value and unit text of a bin in the code's most frequent unit."""
    main = dominant_unit(grids).select(F.col("item_code").alias("__c"), F.col("unit").alias("__u"),
                                       F.col("grid").alias("__g"))
    return (rows.join(main, F.col("item_code") == F.col("__c"), "left")
            .withColumn(out, c.bin_to_value(index, "__g"))
            .withColumn(f"{out}_text", F.concat_ws(" ", F.col(out).cast("string"), F.col("__u")))
            .drop("__c", "__u", "__g"))


def cumulative_coverage(counts: DataFrame, code: str, count: str, share: float) -> DataFrame:
    """Most frequent codes that together stay within `share` of all counts."""
    keyed = counts.withColumn("__neg", -F.col(count))
    ranked = o.ordered_scan(keyed, [], ["__neg", code], o.number_segment("__neg"), {
        "running": o.running_sum(F.col(count)), "total": o.total("sum", F.col(count))})
    return ranked.filter(F.col("running") <= F.col("total") * F.lit(share)).drop("__neg")
