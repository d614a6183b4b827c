"""Cohorts: visit spans, temporal split, descriptive statistics, prevalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import order_stats as q
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c
from chronoline.operators.clean import period

DAY = 1440
KINDS = {"dx": (fv.DIAGNOSIS,), "med": fv.MEDICATION_TYPES, "lab": (fv.LAB,)}


def visit_span(*tables: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last time per patient over all record tables."""
    merged = tables[0].select("patient_id", ts)
    for t in tables[1:]:
        merged = merged.unionByName(t.select("patient_id", ts))
    return merged.groupBy("patient_id").agg(
        F.min(ts).alias("first_visit_date"), F.max(ts).alias("last_visit_date"))


def temporal_split(spans: DataFrame, train: tuple[str, str], test: tuple[str, str],
                   train_size: float = 0.8, val_size: float = 0.1, seed: int = 0) -> DataFrame:
    """(patient_id, split) with split train, validation or test.

    Patients seen only before the test period train, patients first seen in
    it test; of those spanning both, the newest fill the test share. The
    validation part of the rest is chosen by digest order. Ranks are found
    over date pieces and digest pieces, not in one sorted task.
    """
    train_lo, train_hi = period(*train)
    test_lo, test_hi = period(*test)
    first, last = F.col("first_visit_date"), F.col("last_visit_date")
    scope = spans.filter(
        first.isNotNull() & last.isNotNull() & ~(last < train_lo) & ~(first > test_hi)
        & ~((first > train_hi) & (last < test_lo)))
    group = F.when(last < test_lo, "early").when(first >= test_lo, "test").otherwise("both")
    scope = scope.withColumn("__g", group).withColumn(
        "__neg", -F.unix_seconds(first.cast("timestamp")))
    ranked = o.ordered_scan(scope, ["__g"], ["__neg", "patient_id"], F.floor(F.col("__neg") / 86400),
                            {"__rank": o.row_number()})
    share = F.lit(1.0) - F.lit(train_size) - F.lit(val_size)
    n_scope, n_certain = (scope.select(x).scalar() for x in (F.count(F.lit(1)), F.count_if(F.col("__g") == "test")))
    gap = F.greatest(F.floor(n_scope * share) - n_certain, F.lit(0))
    is_test = (F.col("__g") == "test") | ((F.col("__g") == "both") & (F.col("__rank") <= gap))
    marked = ranked.withColumns({"__test": is_test, "__d": c.stable_digest(seed, "patient_id")})
    shuffled = o.ordered_scan(marked, ["__test"], ["__d", "patient_id"], o.hash_segment("__d"), {
        "__pos": o.row_number(), "__m": o.total("sum", F.lit(1))})
    n_train = F.floor(F.col("__m") * F.lit(train_size) / (F.lit(train_size) + F.lit(val_size)))
    split = F.when(F.col("__test"), "test").when(F.col("__pos") <= n_train, "train") \
        .otherwise("validation")
    return shuffled.select("patient_id", split.alias("split"))


def split_members(splits: DataFrame, group: str, included: DataFrame | None = None) -> DataFrame:
    """Ids of one split, or only those in `included`."""
    ids = splits.filter(F.col("split") == group).select("patient_id")
    return ids if included is None else ids.join(included.select("patient_id"), "patient_id",
                                                 "left_semi")


def first_age_between(events: DataFrame, low_years: int, high_years: int) -> DataFrame:
    """Patients whose first row falls in an age range."""
    years = F.floor(F.col("first_age_min") / (365 * DAY))
    return (events.groupBy("patient_id").agg(F.min("age_min").alias("first_age_min"))
            .filter(years.between(low_years, high_years)))


def ages_at_start(labelled: DataFrame, low_years: int = 18, high_years: int = 90) -> DataFrame:
    """Age at the first row of the included train patients."""
    rows = labelled.filter((F.col("row_no") == 0) & (F.col("split") == "train") & (F.col("included") == 1))
    years = F.floor(F.col("age_min") / (365 * DAY))
    return rows.filter(years.between(low_years, high_years)).select("patient_id", "age_min")


def patient_facts(events: DataFrame, stays: DataFrame) -> DataFrame:
    """One row per patient: what cohort statistics need.

    Stays come as admission-discharge pairs.
    """
    base_dx = (F.col("type") == fv.DIAGNOSIS) & ~F.col("code").endswith(fv.PROVISIONAL_SUFFIX)
    facts = events.groupBy("patient_id").agg(
        F.max((F.col("code") == "[M]").cast("int")).alias("men"),
        F.max((F.col("code") == "[F]").cast("int")).alias("women"),
        F.min("age_min").alias("first_age"), F.max("age_min").alias("last_age"),
        *[F.max((base_dx & F.col("code").rlike(rx)).cast("int")).alias(name)
          for name, rx in fv.MAJOR_DIAGNOSES.items()])
    per = stays.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.count_if(F.col("outcome") == "[DSC_ALV]").alias("survived"),
        F.count_if(F.col("outcome") == "[DSC_EXP]").alias("expired"))
    joined = facts.join(per, "patient_id", "left").na.fill(0, ["n_stays", "survived", "expired"])
    return joined.withColumns({
        "age_years": F.floor(F.col("first_age") / (365 * DAY)),
        "follow_up_days": F.ceil((F.col("last_age") - F.col("first_age")) / DAY)})


def cohort_stats(events: DataFrame, stays: DataFrame, keys: Sequence[str] = (),
                 weights: DataFrame | None = None) -> DataFrame:
    """Long statistics (keys, statistic, value) of a cohort or of bootstrap replicates.

    `weights` has (keys, patient_id, weight): how often each patient was drawn.
    Rows of a patient are counted once and weighted, never copied.
    """
    keys = list(keys)
    facts = patient_facts(events, stays)
    lengths = stays.select("patient_id", F.col("los_days").cast("double").alias("value"))
    if weights is None:
        facts = facts.withColumn("weight", F.lit(1).cast("long"))
        lengths = lengths.withColumn("weight", F.lit(1).cast("long"))
    else:
        facts = weights.join(facts, "patient_id")
        lengths = weights.join(lengths, "patient_id")
    w = F.col("weight")

    def summed(name: str) -> Column:
        return F.sum(F.col(name) * w)

    totals = facts.groupBy(*keys).agg(
        F.sum(w).cast("double").alias("n_patients"),
        F.try_divide(summed("men"), summed("women")).alias("male_to_female"),
        summed("n_stays").cast("double").alias("n_admissions"),
        summed("survived").cast("double").alias("n_survived"),
        summed("expired").cast("double").alias("n_expired"),
        F.round(F.try_divide(summed("expired"), summed("n_stays")), 4).alias("inhospital_death_rate"),
        *[summed(name).cast("double").alias(f"n_{name}") for name in fv.MAJOR_DIAGNOSES])
    names = [n for n in totals.columns if n not in keys]
    out = totals.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in names])).alias("s")
    ).select(*keys, "s.*")
    per_patient = F.explode(F.array(*[
        F.struct(F.lit(name).alias("series"), F.col(column).cast("double").alias("value"))
        for name, column in (("age", "age_years"), ("period", "follow_up_days"))]))
    series = facts.select(*keys, "weight", per_patient.alias("s")).select(*keys, "s.*", "weight").unionByName(
        lengths.select(*keys, F.lit("length_of_stay").alias("series"), "value", "weight"))
    group = [*keys, "series"]
    counts = q.value_counts(series, group, "value", weight="weight")
    middle = q.percentiles(counts, group, "value", {"median": 0.5}).drop("n")
    means = counts.groupBy(*group).agg(
        q.weighted_mean(F.col("value"), F.col("cnt")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    around = counts.join(means.select(*group, "mean"), group).groupBy(*group).agg(F.sqrt(
        F.sum(F.col("cnt") * F.pow(F.col("value") - F.col("mean"), 2)) / F.sum("cnt")).alias("std"))
    wide = means.join(middle, group).join(around, group)
    parts = ("mean", "median", "std", "min", "max")
    return out.unionByName(wide.select(*keys, F.explode(F.array(*[
        F.struct(F.concat("series", F.lit(f"_{p}")).alias("statistic"), F.col(p).alias("value"))
        for p in parts])).alias("s")).select(*keys, "s.*"))


def code_kind() -> Column:
    expr = None
    for name, types in KINDS.items():
        cond = F.col("type").isin(*types)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def code_prevalence(events: DataFrame, keys: Sequence[str] = (), weights: DataFrame | None = None
                    ) -> DataFrame:
    """(keys, kind, code, n_records, n_patients), optionally weighted per replicate."""
    keys = list(keys)
    per = (events.withColumn("kind", code_kind()).filter(F.col("kind").isNotNull())
           .groupBy("patient_id", "kind", "code").agg(F.count(F.lit(1)).alias("__n")))
    per = per.withColumn("weight", F.lit(1).cast("long")) if weights is None else \
        weights.join(per, "patient_id")
    return per.groupBy(*keys, "kind", "code").agg(
        F.sum(F.col("__n") * F.col("weight")).alias("n_records"),
        F.sum("weight").alias("n_patients"))


def prevalence_compare(real: DataFrame, synthetic: DataFrame, n_synthetic: DataFrame,
                       n_real: DataFrame, replicate: str = "replicate", ci: float = 0.95,
                       n_shown: int | None = None) -> DataFrame:
    """Bootstrap prevalence of real data against synthetic prevalence, in percent.

    `real` has (replicate, kind, code, n_patients), `n_real` (replicate,
    n_total), `synthetic` (kind, code, n_patients), `n_synthetic` one row with
    n_total. A code absent from a replicate counts as zero there.
    """
    keys = ["kind", "code"]
    rates = real.join(n_real, replicate).withColumn(
        "rate", F.col("n_patients") / F.col("n_total")).select(*keys, replicate, "rate")
    n_rep = n_real.select(F.count_distinct(replicate)).scalar()
    counts = q.value_counts(rates, keys, "rate")
    missing = counts.groupBy(*keys).agg((n_rep - F.sum("cnt")).alias("cnt")).filter(
        F.col("cnt") > 0).select(*keys, F.lit(0.0).alias("rate"), "cnt")
    full = counts.unionByName(missing)
    tail = (1 - ci) / 2
    bounds = q.percentiles(full, keys, "rate", {"real_lower": tail, "real_upper": 1 - tail}).drop("n")
    means = full.groupBy(*keys).agg(q.weighted_mean(F.col("rate"), F.col("cnt")).alias("real_mean"))
    syn = synthetic.select(*keys, (F.col("n_patients") / n_synthetic.select("n_total").scalar())
                           .alias("syn_prev"))
    joined = means.join(bounds, keys).join(syn, keys, "full_outer").na.fill(0.0)
    out = joined.select(*keys, *[(F.col(n) * 100).alias(n)
                                 for n in ("syn_prev", "real_mean", "real_lower", "real_upper")])
    if n_shown is None:
        return out
    return top_n(out, ["kind"], "real_mean", n_shown, "code")


def top_n(df: DataFrame, keys: Sequence[str], measure: str, n: int, tie: str) -> DataFrame:
    """First `n` rows per key by descending measure.

    A filter on the row number of a window: each task keeps its own first `n`
    rows per key before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(measure).desc_nulls_last(), tie))
    return df.withColumn("__r", place).filter(F.col("__r") <= n).drop("__r")
