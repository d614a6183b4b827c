"""Resampling by stable digests: the same draw on any layout and any retry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import order_stats as q
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c

DAY = 1440


def dense_index(ids: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """(key, idx, n): dense zero-based index of each id in digest order."""
    keyed = ids.select(key).distinct().withColumn("__d", c.stable_digest(seed, key))
    scanned = o.ordered_scan(keyed, [], ["__d", key], o.hash_segment("__d"), {
        "idx": o.row_number(), "n": o.total("sum", F.lit(1))})
    return scanned.select(key, (F.col("idx") - 1).alias("idx"), "n")


def bootstrap_weights(ids: DataFrame, replicates: int, size: int | None = None, seed: int = 0,
                      key: str = "patient_id", numbered: bool = False) -> DataFrame:
    """(replicate, key, weight): draws with replacement, counted per id.

    Every id carries one draw slot per replicate (or `size` draws in all), so
    the draws are made where the ids are and only (replicate, index, count)
    travels.
    """
    indexed = dense_index(ids, key, seed)
    n = ids.select(F.count_distinct(key)).scalar()
    if size is None:
        slots = indexed.select(F.col("idx").alias("slot"))
    else:
        slots = ids.sparkSession.range(size).select(F.col("id").alias("slot"))
    draws = slots.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    pick = c.digest_index(c.stable_digest(seed, "replicate", "slot"), n)
    drawn = draws.withColumn("idx", pick)
    if numbered:
        named = drawn.join(indexed.select("idx", key), "idx")
        return named.select("replicate", "slot", key)
    counted = drawn.groupBy("replicate", "idx").agg(F.count(F.lit(1)).alias("weight"))
    return counted.join(indexed.select("idx", key), "idx").select("replicate", key, "weight")


def bootstrap_rows(df: DataFrame, draws: DataFrame, key: str = "patient_id") -> DataFrame:
    """Rows of every drawn id under a new id per draw, for aggregates that need copies.

    The new id is the old one with the number of its draw in the replicate.
    """
    numbered = o.ordered_scan(draws.withColumn("__d", c.stable_digest(0, "slot")),
                              ["replicate", key], ["__d", "slot"], o.hash_segment("__d"),
                              {"draw_no": o.row_number()})
    copies = numbered.select("replicate", key, "draw_no")
    return copies.join(df, key).withColumn(
        "new_id", F.concat_ws("_", key, F.col("draw_no").cast("string")))


def bootstrap_apply(df: DataFrame, weights: DataFrame, by: Sequence[str], aggregates: Sequence[Column],
                    key: str = "patient_id") -> DataFrame:
    """Weighted aggregates per replicate; `aggregates` read the `weight` column."""
    return weights.join(df, key).groupBy("replicate", *by).agg(*aggregates)


def bootstrap_ci(stats: DataFrame, by: Sequence[str], value: str = "value", ci: float = 0.95
                 ) -> DataFrame:
    """Mean, lower and upper percentile of a statistic over replicates."""
    counts = q.value_counts(stats, by, value)
    tail = (1 - ci) / 2
    means = counts.groupBy(*by).agg(q.weighted_mean(F.col(value), F.col("cnt")).alias("mean"))
    return means.join(q.percentiles(counts, by, value, {"lower": tail, "upper": 1 - tail}).drop("n"),
                      list(by))


def trajectory_lists(ids: DataFrame, keys: Sequence[str], sim: str = "sim_id") -> DataFrame:
    """(keys, sims): the sorted simulations of each snapshot, whose number is a run parameter."""
    return ids.select(*keys, sim).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(sim)).alias("sims"))


def _picked(lists: DataFrame, keys: Sequence[str], sizes: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """(keys, sims, sample_size, repeat, picked): places (from 0) in `sims` of the smallest digests."""
    grid = [F.struct(F.lit(s).alias("size"), F.lit(r).alias("repeat")) for s in sizes for r in range(repeats)]
    spread = lists.withColumn("__g", F.explode(F.array(*grid))).select(
        "*", F.col("__g.size").alias("sample_size"), F.col("__g.repeat").alias("repeat")).drop("__g")

    def marked(x: Column, i: Column) -> Column:
        return F.struct(c.stable_digest(seed, *keys, "sample_size", "repeat", x).alias("d"), x.alias("sim"), i.cast("int").alias("at"))
    chosen = F.slice(F.array_sort(F.transform("sims", marked)), F.lit(1), F.col("sample_size"))
    return spread.withColumn("picked", F.transform(chosen, lambda p: p["at"]))


def subsample_trajectories(ids: DataFrame, keys: Sequence[str], sizes: Sequence[int], repeats: int,
                           seed: int = 0, sim: str = "sim_id") -> DataFrame:
    """(keys, sample_size, repeat, sim): that many simulations, without replacement.

    The simulations of a snapshot are one row; the samples are drawn inside it.
    """
    drawn = _picked(trajectory_lists(ids, keys, sim), keys, sizes, repeats, seed)
    return drawn.select(*keys, "sample_size", "repeat", F.explode(F.transform(
        "picked", lambda i: F.get("sims", i))).alias(sim))


def place_bits(places: Column, size: Column) -> Column:
    """Bitmap of places (from 0) below `size`: 64 to a word, as an array of longs."""
    one = F.lit(1).cast("long")

    def word(w: Column) -> Column:
        own = F.filter(places, lambda p: F.floor(p / 64) == w)
        # shiftleft takes the shift modulo 64
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", one, p.cast("int"))))
    return F.transform(F.sequence(F.lit(0), F.ceil(size / 64).cast("int") - 1), word)


def sample_masks(ids: DataFrame, keys: Sequence[str], sizes: Sequence[int], repeats: int, seed: int = 0,
                 sim: str = "sim_id") -> DataFrame:
    """(keys, sims, sample_size, repeat, mask, n_sim): `subsample_trajectories` as bitmaps over `sims`."""
    drawn = _picked(trajectory_lists(ids, keys, sim), keys, sizes, repeats, seed)
    return drawn.select(*keys, "sims", "sample_size", "repeat", place_bits(F.col("picked"), F.size("sims")).alias("mask"),
                        F.size("picked").cast("long").alias("n_sim"))


def draw_samples(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """The `n` rows of least digest, without replacement; `available` holds the row count."""
    available = df.select(F.count(F.lit(1))).scalar()
    enough = F.when(F.col("available") >= n, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit(f"asked for {n} samples, available: "),
                               F.col("available").cast("string"))).cast("boolean"))
    least = df.withColumn("__d", c.stable_digest(seed, *key)).orderBy("__d", *key).limit(n)
    return least.withColumn("available", available).filter(enough).drop("__d")


def draw_with_replacement(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """`n` rows drawn with replacement, numbered by `draw`."""
    keyed = df.withColumn("__d", c.stable_digest(seed, *key))
    size = df.count()
    indexed = o.ordered_scan(keyed, [], ["__d", *key], o.hash_segment("__d", o.digits_for(size)), {
        "__i": o.row_number()}).drop("__d")
    total = F.lit(size)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"))
    draws = draws.withColumn("__i", c.digest_index(c.stable_digest(seed, "draw"), total) + 1)
    return draws.join(indexed, "__i").drop("__i")


def available_samples(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("available"))


def sample_ages(ages: DataFrame, n: int, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """Start ages drawn with replacement, moved by up to 5 % of their years, cut to days."""
    drawn = draw_with_replacement(ages, n, ["patient_id"], seed)
    u = c.digest_uniform(c.stable_digest(seed, "draw", F.lit("noise"))) * 2 - 1
    years = F.col("age_min") / (365.0 * DAY)
    moved = F.col("age_min") + u * noise * years * 365 * DAY
    return drawn.select("draw", "patient_id", (F.floor(moved / DAY) * DAY).cast("long").alias("age_min"))


def epoch_resample(metadata: DataFrame, max_length: int, epoch: int, seed: int = 0,
                   max_weight: float = 10.0) -> DataFrame:
    """Length-weighted draw with replacement, as many as the weights add up to (rounded up).

    Weights are clip(length / max_length, 1, max_weight). Points on the
    cumulative weight line are matched to timelines with an ordered scan.
    """
    # Weights in whole rows, whose sum does not depend on the layout.
    weight = F.least(F.greatest(F.col("effective_length").cast("long"), F.lit(max_length)), F.lit(int(max_weight * max_length)).cast("long"))
    keyed = metadata.select("patient_id", weight.alias("__w")).withColumn(
        "__d", c.stable_digest(seed, "patient_id"))
    sum_, rows = keyed.agg(F.coalesce(F.sum("__w"), F.lit(0)), F.count(F.lit(1))).first()
    line = o.ordered_scan(keyed, [], ["__d", "patient_id"], o.hash_segment("__d", o.digits_for(rows)), {
        "__end": o.running_sum(F.col("__w"))})
    total, n = F.lit(sum_).cast("double"), -(-sum_ // max_length)
    points = metadata.sparkSession.range(1, n + 1).select(F.col("id").alias("draw")).withColumn(
        "__x", c.digest_uniform(c.stable_digest(seed, F.lit(epoch), "draw")) * total)
    starts = line.select((F.col("__end") - F.col("__w")).cast("double").alias("__x"), F.lit(0).alias("__r"),
                         "patient_id", F.lit(None).cast("long").alias("draw"))
    merged = starts.unionByName(points.select("__x", F.lit(1).alias("__r"),
                                              F.lit(None).cast("string").alias("patient_id"), "draw"))
    piece = F.floor(F.col("__x") / F.greatest(total / F.lit(max(n / 4096.0, 1.0)),
                                              F.lit(1e-9)))
    found = o.ordered_scan(merged.withColumn("__tie", F.coalesce("draw", F.lit(-1))), [],
                           ["__x", "__r", "__tie"], piece,
                           {"drawn": o.last_before(F.col("patient_id"))})
    return found.filter(F.col("__r") == 1).select(F.lit(epoch).alias("epoch"), "draw",
                                                  F.col("drawn").alias("patient_id"))


def counterfactual_variants(snapshots: DataFrame, rows: DataFrame, keys: Sequence[str],
                            age_shifts_years: Sequence[int] = (0, 5, 10, 15)) -> DataFrame:
    """Copies of each snapshot history with all ages moved by some years."""
    shifts = F.explode(F.array(*[F.lit(y) for y in age_shifts_years]))
    copies = rows.withColumn("shift_years", shifts)
    return copies.withColumn("age_min", F.col("age_min") + F.col("shift_years") * (365 * DAY)).join(
        snapshots.select(*keys).distinct(), list(keys), "left_semi")


def counterfactual_lab(rows: DataFrame, target: DataFrame, grids: DataFrame,
                       deltas: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """Copies of each history with one lab value changed and put on the grid again.

    `target` has (keys, record id) of the changed result; other lab rows of the
    same time are removed.
    """
    from chronoline.operators.labstats import nearest_bins
    marked = target.select(*keys, F.col("unique_record_id").alias("__rid"), F.col("age_min").alias("__at"))
    joined = rows.join(marked, list(keys))
    is_target = F.col("unique_record_id") == F.col("__rid")
    same_time_lab = (F.col("type") == fv.LAB) & (F.col("age_min") == F.col("__at")) & ~is_target
    copies = joined.filter(~same_time_lab).withColumn(
        "delta", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    moved = copies.withColumn("numeric", F.when(is_target, F.col("numeric") + F.col("delta"))
                              .otherwise(F.col("numeric")))
    return nearest_bins(moved, grids).drop("__rid", "__at")
