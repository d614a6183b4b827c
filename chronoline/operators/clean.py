"""Projection, cleaning and period filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoline import fixed_values as fv
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c


def conform(df: DataFrame, columns: dict[str, T.DataType]) -> DataFrame:
    """Keep the declared columns in the declared types; bad values become null."""
    out = []
    for name, kind in columns.items():
        value = F.col(name).try_cast(kind)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        out.append(value.alias(name))
    return df.select(*out)


def drop_missing_any(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(columns)) if columns else df


def drop_missing_all(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop("all", subset=list(columns)) if columns else df


def floor_to_minute(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, c.minute_floor(ts))


def attach_birth(df: DataFrame, patients: DataFrame) -> DataFrame:
    return df.join(patients.select("patient_id", "date_of_birth"), "patient_id", "left")


def with_age(df: DataFrame, patients: DataFrame, ts: str = "ts") -> DataFrame:
    """Age in minutes at `ts`; rows before birth or without birth date are dropped."""
    birth = F.col("date_of_birth").cast("timestamp_ntz")
    return (attach_birth(df, patients)
            .withColumn("age_min", c.minutes_between(birth, F.col(ts)))
            .filter(F.col("age_min") >= 0).drop("date_of_birth"))


def with_time_available(df: DataFrame, patients: DataFrame, available: str) -> DataFrame:
    """Age at which a record became known; unknown or negative counts as 0."""
    birth = F.col("date_of_birth").cast("timestamp_ntz")
    known = c.minutes_between(birth, F.col(available))
    return (attach_birth(df, patients)
            .withColumn("time_available_min", F.greatest(F.coalesce(known, F.lit(0)), F.lit(0)))
            .drop("date_of_birth"))


def cleaning_report(df: DataFrame, patients: DataFrame, any_of: Sequence[str],
                    all_of: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """One row: rows before, nulls per column, rows dropped, negative ages, rows after."""
    missing = F.lit(False)
    for name in any_of:
        missing = missing | F.col(name).isNull()
    if all_of:
        empty = F.lit(True)
        for name in all_of:
            empty = empty & F.col(name).isNull()
        missing = missing | empty
    birth = F.col("date_of_birth").cast("timestamp_ntz")
    age = c.minutes_between(birth, F.col(ts))
    kept = ~missing & F.coalesce(age >= 0, F.lit(False))
    return attach_birth(df, patients).agg(
        F.count(F.lit(1)).alias("rows_before"),
        *[F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in [*any_of, *all_of]],
        F.count_if(missing).alias("rows_missing"),
        F.count_if(~missing & (age < 0)).alias("negative_ages"),
        F.count_if(kept).alias("rows_after"))


def clean_records(df: DataFrame, patients: DataFrame, any_of: Sequence[str],
                  all_of: Sequence[str] = (), ts: str = "timestamp",
                  available: str | None = None) -> DataFrame:
    """Drop incomplete rows, cut times to the minute, add ages."""
    kept = drop_missing_all(drop_missing_any(df, any_of), all_of)
    kept = kept.withColumn(ts, c.minute_floor(ts))
    birth = F.col("date_of_birth").cast("timestamp_ntz")
    known = c.minutes_between(birth, F.col(available)) if available else F.lit(None).cast("long")
    return (attach_birth(kept, patients)
            .withColumn("age_min", c.minutes_between(birth, F.col(ts)))
            .filter(F.col("age_min") >= 0)
            .withColumn("time_available_min", F.greatest(F.coalesce(known, F.lit(0)), F.lit(0)))
            .drop("date_of_birth"))


def period(start: str, end: str) -> tuple[Column, Column]:
    """Bounds of a period of whole days."""
    return (F.lit(f"{start} 00:00:00").cast("timestamp_ntz"),
            F.lit(f"{end} 23:59:59").cast("timestamp_ntz"))


def filter_cohort_period(df: DataFrame, ids: DataFrame, start: str, end: str,
                         ts: str = "ts") -> DataFrame:
    lo, hi = period(start, end)
    return (df.filter(F.col(ts).between(lo, hi))
            .join(ids.select("patient_id").distinct(), "patient_id", "left_semi"))


def flag_periods(df: DataFrame, periods: dict[str, tuple[str, str]], ts: str = "ts") -> DataFrame:
    """One 0/1 column per named period."""
    return df.withColumns({
        name: F.coalesce(F.col(ts).between(*period(*bounds)), F.lit(False)).cast("int")
        for name, bounds in periods.items()})


def drop_out_of_period(df: DataFrame) -> DataFrame:
    """Rows of the train or test period, and every demographic row."""
    return df.filter((F.col("train_period") == 1) | (F.col("test_period") == 1)
                     | (F.col("type") == fv.DEMOGRAPHICS))


def out_of_period_report(df: DataFrame, record: str = "unique_record_id") -> DataFrame:
    """Distinct dropped records per type."""
    gone = df.filter((F.col("train_period") != 1) & (F.col("test_period") != 1)
                     & (F.col("type") != fv.DEMOGRAPHICS))
    return gone.groupBy("type").agg(F.count_distinct(record).alias("n_records"))


def drop_demographics_only(df: DataFrame, rows: int = 2) -> DataFrame:
    """Patients with more rows than the demographic ones."""
    long_enough = df.groupBy("patient_id").count().filter(F.col("count") > rows)
    return df.join(long_enough.select("patient_id"), "patient_id", "left_semi")


def select_event_period(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows of the split's own period: test rows for test, train rows otherwise."""
    own = F.when(F.col(split) == "test", F.col("test_period")).otherwise(F.col("train_period"))
    return df.filter((own == 1) | (F.col("type") == fv.DEMOGRAPHICS))


def events_in_windows(events: DataFrame, windows: DataFrame, keys: Sequence[str] = ("patient_id",),
                      start: str = "start_min", end: str = "end_min", age: str = "age_min",
                      closed_start: bool = False, bucket: int = 7 * 1440) -> DataFrame:
    """Window-event pairs with start < age <= end (or start <= age).

    Both sides carry a time bucket, so the join key is (keys, bucket): the rows
    of one long history are spread over tasks and only nearby rows meet.
    """
    cover = F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))
    spread = windows.filter(F.col(end) >= F.col(start)).withColumn("__b", F.explode(cover))
    placed = events.withColumn("__b", F.floor(F.col(age) / bucket))
    after = F.col(age) >= F.col(start) if closed_start else F.col(age) > F.col(start)
    return (spread.join(placed, [*keys, "__b"]).filter(after & (F.col(age) <= F.col(end)))
            .drop("__b"))


def slice_window_keep_demographics(events: DataFrame, windows: DataFrame,
                                   keys: Sequence[str] = ("patient_id",),
                                   start: str = "start_min", end: str = "end_min") -> DataFrame:
    """Rows inside each window, plus the demographic rows of its patient."""
    inside = events_in_windows(events.filter(F.col("type") != fv.DEMOGRAPHICS), windows, keys,
                               start, end)
    head = windows.join(events.filter(F.col("type") == fv.DEMOGRAPHICS), list(keys))
    return inside.unionByName(head)


def known_before(events: DataFrame, snapshots: DataFrame, at: str = "eval_min",
                 available: str = "time_available_min",
                 segment_minutes: int | None = 90 * 1440) -> DataFrame:
    """Snapshot-event pairs known at each snapshot.

    A snapshot first meets the time pieces its patient has rows in (one row
    each); the events then join on (patient, piece). Without pieces the join is by
    patient alone, which moves no event of a table in patient blocks.
    """
    if segment_minutes is None:
        return snapshots.join(events, "patient_id").filter(
            (F.col("age_min") <= F.col(at)) & (F.col(available) <= F.col(at)))
    placed = events.withColumn("__b", o.time_segment("age_min", segment_minutes))
    pieces = placed.select("patient_id", "__b").distinct()
    spread = snapshots.join(pieces, "patient_id").filter(
        F.col("__b") <= o.time_segment(at, segment_minutes))
    return (spread.join(placed, ["patient_id", "__b"])
            .filter((F.col("age_min") <= F.col(at)) & (F.col(available) <= F.col(at)))
            .drop("__b"))
