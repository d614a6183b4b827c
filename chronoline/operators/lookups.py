"""Joins with dictionaries, statistics and other events of a patient.

Dictionary joins are plain left joins: Spark broadcasts a dictionary below its
size threshold and otherwise shuffles, splitting partitions of hot codes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c
from chronoline.operators.clean import events_in_windows


def oov_tokens(width: int) -> Column:
    return F.array(F.lit(fv.OOV_INDEX), *[F.lit(0)] * (width - 1))


def pad_tokens(width: int) -> Column:
    return F.array_repeat(F.lit(0), width)


def map_codes_to_tokens(df: DataFrame, token_map: DataFrame, code: str, width: int) -> DataFrame:
    """Token array of each code; unknown codes get the out-of-vocabulary array.

    `token_map` has (original_value, tokens). Empty codes get zeros.
    """
    named = token_map.select(F.col("original_value").alias("__v"), "tokens")
    empty = F.col(code).isNull() | (F.col(code) == "")
    return (df.join(named, F.col(code) == F.col("__v"), "left").drop("__v")
            .withColumn("tokens", F.when(empty, pad_tokens(width))
                        .otherwise(F.coalesce("tokens", oov_tokens(width)))))


def with_provisional_names(names: DataFrame) -> DataFrame:
    """Diagnosis names doubled by their provisional form."""
    suffix = fv.PROVISIONAL_SUFFIX
    return names.unionByName(names.select(
        F.concat("item_code", F.lit(suffix)).alias("item_code"),
        F.concat("item_name", F.lit(" " + suffix)).alias("item_name")))


def map_code_names(df: DataFrame, names: DataFrame, code: str, out: str = "text",
                   provisional: bool = False) -> DataFrame:
    """Name of each code, or the code itself where there is none."""
    table = with_provisional_names(names) if provisional else names
    table = table.select(F.col("item_code").alias("__c"), F.col("item_name").alias("__n"))
    return (df.join(table, F.col(code) == F.col("__c"), "left")
            .withColumn(out, F.coalesce("__n", code)).drop("__c", "__n"))


def map_token_names(df: DataFrame, token: str, out: str = "text") -> DataFrame:
    return df.withColumn(out, c.token_description(token))


def attach_lab_stats(labs: DataFrame, numeric: DataFrame, nonnumeric: DataFrame) -> DataFrame:
    """Add `num_count` by (code, unit) and `nonnum_count`, `token` by (code, value).

    Null units match null units.
    """
    n = numeric.select(F.col("item_code").alias("__nc"), F.col("unit").alias("__nu"),
                       F.col("count").alias("num_count"))
    t = nonnumeric.select(F.col("item_code").alias("__tc"), F.col("nonnumeric").alias("__tv"),
                          F.col("count").alias("nonnum_count"), "token")
    return (labs
            .join(n, F.col("item_code").eqNullSafe(F.col("__nc"))
                  & F.coalesce("unit", F.lit("")).eqNullSafe(F.coalesce("__nu", F.lit(""))), "left")
            .join(t, F.col("item_code").eqNullSafe(F.col("__tc"))
                  & F.col("nonnumeric").eqNullSafe(F.col("__tv")), "left")
            .drop("__nc", "__nu", "__tc", "__tv"))


def next_event(anchors: DataFrame, events: DataFrame, at: str, age: str, value: Column,
               out: str, anchor_id: Sequence[str], strict: bool = True,
               keys: Sequence[str] = ("patient_id",), segment_minutes: int = 7 * 1440) -> DataFrame:
    """`value` of the first event after each anchor (or at it, when not strict).

    Events and anchors are merged into one ordered list, so nothing multiplies.
    `value` must be non-null on events.
    """
    return _nearest(anchors, events, at, age, value, out, anchor_id, keys, segment_minutes,
                    event_rank=0 if strict else 2, forward=True)


def previous_event(anchors: DataFrame, events: DataFrame, at: str, age: str, value: Column,
                   out: str, anchor_id: Sequence[str], keys: Sequence[str] = ("patient_id",),
                   tie: Sequence[str] = (), segment_minutes: int = 7 * 1440) -> DataFrame:
    """`value` of the latest event at or before each anchor."""
    return _nearest(anchors, events, at, age, value, out, anchor_id, keys, segment_minutes,
                    event_rank=0, forward=False, tie=tie)


def _nearest(anchors, events, at, age, value, out, anchor_id, keys, segment_minutes,
             event_rank, forward, tie=()):
    keys = list(keys)
    a = anchors.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__r"),
                       F.struct(*anchors.columns).alias("__a"), F.lit("").alias("__x"))
    order_text = F.concat_ws("|", *[F.lpad(F.col(t).cast("string"), 20, "0") for t in tie]) \
        if tie else F.lit("")
    e = events.select(*keys, F.col(age).alias("__t"), F.lit(event_rank).alias("__r"),
                      value.alias("__v"), order_text.alias("__x"))
    merged = a.unionByName(e, allowMissingColumns=True)
    merged = merged.withColumn("__id", F.concat_ws("|", *[
        F.col(f"__a.{i}").cast("string") for i in anchor_id]))
    scan = o.first_after(F.col("__v")) if forward else o.last_before(F.col("__v"))
    found = o.ordered_scan(merged, keys, ["__t", "__r", "__x", "__id"],
                           o.time_segment("__t", segment_minutes), {out: scan})
    return found.filter(F.col("__r") == 1).select("__a.*", out)


def pair_admissions(events: DataFrame, segment_minutes: int = 7 * 1440) -> DataFrame:
    """Closest discharge at or after each admission time of a patient."""
    adm = (events.filter((F.col("code") == "[ADM]") & F.col("age_min").isNotNull())
           .select("patient_id", F.col("age_min").alias("adm_min")).distinct())
    dsc = events.filter((F.col("code") == "[DSC]") & F.col("age_min").isNotNull()).select(
        "patient_id", "age_min")
    paired = next_event(adm, dsc, "adm_min", "age_min", F.col("age_min"), "dsc_min",
                        ["adm_min"], strict=False, segment_minutes=segment_minutes)
    return paired.filter(F.col("dsc_min").isNotNull())


def interval_cohort(admissions: DataFrame, labs: DataFrame, patients: DataFrame,
                    codes: Sequence[str], positive: str, since: str,
                    hours: int = 24, years: int = 20) -> DataFrame:
    """Adult admissions with a positive test of `codes` within some hours."""
    tests = (labs.filter(F.col("item_code").isin(*codes) & (F.col("nonnumeric") == positive))
             .select("patient_id", F.col("ts").alias("lab_ts"),
                     F.unix_seconds(F.col("ts").cast("timestamp")).alias("age_min")))
    span = hours * 3600
    anchor = F.unix_seconds(F.col("adm_ts").cast("timestamp"))
    birth = F.add_months("date_of_birth", 12 * years).cast("timestamp_ntz")
    adults = (admissions.filter(F.col("adm_ts") >= F.lit(since).cast("timestamp_ntz"))
              .join(patients.select("patient_id", "date_of_birth"), "patient_id")
              .filter(F.col("adm_ts") >= birth)
              .withColumns({"start_min": anchor - span, "end_min": anchor + span}))
    return (events_in_windows(tests, adults, closed_start=True, bucket=span)
            .select(*admissions.columns, "lab_ts").distinct())


def first_event_after(cohort: DataFrame, labs: DataFrame, code: str,
                      anchor_id: Sequence[str], segment_seconds: int = 7 * 86400) -> DataFrame:
    """Earliest record of `code` strictly after both cohort times, where there is one.

    One row per `anchor_id`: with several matching tests the earliest follow-up wins.
    """
    target = labs.filter(F.col("item_code") == code).select(
        "patient_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("__s"), "ts")
    anchors = cohort.withColumn(
        "__at", F.unix_seconds(F.greatest("adm_ts", "lab_ts").cast("timestamp")))
    found = next_event(anchors, target, "__at", "__s", F.col("ts"), "next_ts",
                       [*anchor_id, "lab_ts"], segment_minutes=segment_seconds)
    rest = [n for n in cohort.columns if n not in anchor_id]
    picked = (found.filter(F.col("next_ts").isNotNull()).groupBy(*anchor_id)
              .agg(F.min_by(F.struct(*rest, "next_ts"), F.struct("next_ts", "lab_ts")).alias("r")))
    return picked.select(*anchor_id, "r.*")


def neutrophil_counts(events: DataFrame, keys: Sequence[str] = ("patient_id",),
                      rules: dict = fv.NEUTROPENIA) -> DataFrame:
    """Absolute count from white cells and neutrophil share of the same time.

    The lowest count of a (patient, age) is kept.
    """
    at = [*keys, "age_min"]
    result = F.coalesce("result", F.lit(""))
    is_wbc = (F.col("code") == rules["wbc_code"]) & result.endswith(rules["wbc_unit"])
    is_share = F.col("code").isin(*rules["neutrophil_codes"]) & result.endswith(rules["neutrophil_unit"])
    number = c.any_number("result")
    # counts and shares are unsigned, so the product of the minima is the lowest product
    lowest = events.filter(is_wbc | is_share).groupBy(*at).agg(
        F.min(F.when(is_wbc, number * rules["wbc_const"])).alias("wbc"),
        F.min(F.when(is_share, number * 0.01)).alias("share"))
    return (lowest.select(*at, (F.col("wbc") * F.col("share")).alias("anc"))
            .filter(F.col("anc").isNotNull()))


def keep_ids(df: DataFrame, ids: DataFrame, on: str = "patient_id") -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_semi")


def exclude_ids(df: DataFrame, ids: DataFrame, on: str = "patient_id") -> DataFrame:
    return df.join(ids.select(on).distinct(), on, "left_anti")


def attach_admission_attributes(rows: DataFrame, admissions: DataFrame,
                                record: str = "unique_record_id") -> DataFrame:
    """Department of the admission a row comes from; null for other rows."""
    return rows.join(admissions.select(record, "department"), record, "left")
