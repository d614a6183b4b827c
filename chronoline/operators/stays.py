"""Hospital stays: flags, pairs, day snapshots and sampling tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c
from chronoline.operators.clean import events_in_windows
from chronoline.operators.lookups import pair_admissions

DAY = 1440
EVENT_ORDER = ("age_min", "type", "event_id")


def admitted_markers(code: str = "code") -> tuple[Column, Column]:
    """State set by a row for later rows, and marker seen by earlier rows."""
    head = F.col("type") == fv.DEMOGRAPHICS
    state = F.when(head | (F.col(code) == "[DSC]"), 0).when(F.col(code) == "[ADM]", 1)
    marker = F.when(head | (F.col(code) == "[ADM]"), 0).when(F.col(code) == "[DSC]", 1)
    return state, marker


def admitted_value(state: Column, upcoming: Column, code: str = "code",
                   ignore_truncated: bool = False) -> Column:
    """0/1 flag from the carried state and the next marker.

    Admission and demographic rows never count as "before a discharge".
    """
    start = (F.col("type") == fv.DEMOGRAPHICS) | (F.coalesce(F.col(code), F.lit("")) == "[ADM]")
    inside = F.coalesce(state, F.lit(0)) == 1
    leaving = ~start & (F.coalesce(upcoming, F.lit(0)) == 1)
    return ((inside & leaving) if ignore_truncated else (inside | leaving)).cast("int")


def flag_admitted(df: DataFrame, ignore_truncated: bool = False, code: str = "code",
                  order: Sequence[str] = EVENT_ORDER, out: str = "admitted",
                  segment_minutes: int = 7 * DAY) -> DataFrame:
    """1 on rows inside a stay.

    A stay runs from `[ADM]` to before `[DSC]`. Stays cut off at either end
    count unless `ignore_truncated`.
    """
    state, marker = admitted_markers(code)
    scanned = o.ordered_scan(df, ["patient_id"], order, o.time_segment(order[0], segment_minutes), {
        "__state": o.last_before(state, inclusive=True), "__next": o.first_after(marker)})
    flag = admitted_value(F.col("__state"), F.col("__next"), code, ignore_truncated)
    return scanned.withColumn(out, flag).drop("__state", "__next")


def row_numbers(df: DataFrame, order: Sequence[str] = EVENT_ORDER, out: str = "row_no",
                segment_minutes: int = 7 * DAY) -> DataFrame:
    """Zero-based position of each row in its patient's timeline."""
    scanned = o.ordered_scan(df, ["patient_id"], order, o.time_segment(order[0], segment_minutes),
                             {out: o.row_number()})
    return scanned.withColumn(out, (F.col(out) - 1).cast("long"))


def backfill_demographic_time(df: DataFrame) -> DataFrame:
    """Demographic rows take the day of the patient's first other event."""
    first = (df.filter(F.col("type") != fv.DEMOGRAPHICS).groupBy("patient_id")
             .agg(F.min("age_min").alias("__age"), F.min("ts").alias("__ts")))
    head = F.col("type") == fv.DEMOGRAPHICS
    return (df.join(first, "patient_id", "left")
            .withColumn("age_min", F.when(head, F.floor(F.col("__age") / DAY) * DAY)
                        .otherwise(F.col("age_min")))
            .withColumn("ts", F.when(head, F.date_trunc("day", F.col("__ts")).cast("timestamp_ntz"))
                        .otherwise(F.col("ts")))
            .drop("__age", "__ts"))


def forward_fill(df: DataFrame, column: str, order: Sequence[str] = EVENT_ORDER,
                 keys: Sequence[str] = ("patient_id",), segment_minutes: int = 7 * DAY) -> DataFrame:
    """Carry the last known value down the rows."""
    return o.ordered_scan(df, keys, order, o.time_segment(order[0], segment_minutes),
                          {column: o.last_before(F.col(column), inclusive=True)})


def complete_admissions(events: DataFrame, order: Sequence[str] = EVENT_ORDER,
                        period: str | None = "test_period", code: str = "code",
                        extra: Sequence[str] = (), segment_minutes: int = 7 * DAY) -> DataFrame:
    """Admissions whose next admission-or-discharge row is a discharge.

    With `period`, only rows of that period take part.
    """
    rows = events.filter(F.col(code).isin("[ADM]", "[DSC]"))
    if period:
        rows = rows.filter(F.col(period) == 1)
    seg = o.time_segment(order[0], segment_minutes)
    paired = o.ordered_scan(rows, ["patient_id"], order, seg, {
        "__code": o.lead(F.col(code)), "__age": o.lead(F.col("age_min"))})
    paired = paired.filter((F.col(code) == "[ADM]") & (F.col("__code") == "[DSC]"))
    numbered = o.ordered_scan(paired, ["patient_id"], order, seg, {"__n": o.row_number()})
    return numbered.select(
        "patient_id", (F.col("__n") - 1).cast("int").alias("admission_no"),
        F.col("age_min").alias("adm_min"), F.col("__age").alias("dsc_min"),
        (F.floor(F.col("age_min") / DAY) * DAY).alias("adm_day_min"),
        (F.floor(F.col("__age") / DAY) * DAY).alias("dsc_day_min"), *extra)


def stays(events: DataFrame, order: Sequence[str] = EVENT_ORDER,
          segment_minutes: int = 7 * DAY) -> DataFrame:
    """Admission-discharge pairs with length of stay in started days and outcome."""
    rows = events.filter(F.col("code").isin("[ADM]", "[DSC]"))
    paired = o.ordered_scan(rows, ["patient_id"], order, o.time_segment(order[0], segment_minutes), {
        "__code": o.lead(F.col("code")), "__age": o.lead(F.col("age_min")),
        "outcome": o.lead(F.col("result"))})
    return (paired.filter((F.col("code") == "[ADM]") & (F.col("__code") == "[DSC]"))
            .select("patient_id", F.col("age_min").alias("adm_min"), F.col("__age").alias("dsc_min"),
                    "outcome",
                    F.ceil((F.col("__age") - F.col("age_min")) / DAY).cast("long").alias("los_days")))


def admission_day_snapshots(admissions: DataFrame, eval_minute: int = 720,
                            max_days: int | None = None) -> DataFrame:
    """One row per admission and day whose evaluation time lies inside the stay.

    `max_days` leaves out later days; `days_left_out` counts them.
    """
    n_days = F.floor((F.col("dsc_day_min") - F.col("adm_day_min")) / DAY)
    last = n_days if max_days is None else F.least(n_days, F.lit(max_days))
    days = F.sequence(F.lit(0), last.cast("int"))
    at = F.col("adm_day_min") + F.col("day") * DAY + eval_minute
    return (admissions.withColumn("day", F.explode(days)).withColumn("eval_min", at)
            .filter((F.col("adm_min") <= F.col("eval_min"))
                    & (F.col("eval_min") <= F.col("dsc_min"))))


def days_left_out(admissions: DataFrame, eval_minute: int, max_days: int) -> DataFrame:
    """(n_days, n_left_out): the snapshot days of all stays and those beyond `max_days`."""
    return admission_day_snapshots(admissions, eval_minute).agg(
        F.count(F.lit(1)).alias("n_days"), F.count_if(F.col("day") > max_days).alias("n_left_out"))


def inpatient_day_table(events: DataFrame, hour: int | None = None, min_days: int = 0,
                        max_days: int | None = None, segment_minutes: int = 7 * DAY) -> DataFrame:
    """Every sampling day of every paired stay."""
    pairs = pair_admissions(events, segment_minutes)
    start = F.floor(F.col("adm_min") / DAY)
    end = F.floor(F.col("dsc_min") / DAY)
    if hour is not None:
        end = end - (F.pmod("dsc_min", F.lit(DAY)) < hour * 60).cast("int")
    if min_days:
        start = start + min_days
    elif hour is not None:
        start = start + (F.pmod("adm_min", F.lit(DAY)) > hour * 60).cast("int")
    pairs = pairs.withColumns({"__s": start, "__e": end})
    if max_days is not None:
        pairs = pairs.withColumn("__e", F.least("__e", F.col("__s") + (max_days - 1)))
    return (pairs.filter(F.col("__e") >= F.col("__s"))
            .withColumn("hospital_day", F.explode(F.sequence("__s", "__e")))
            .drop("__s", "__e"))


def baseline_distribution(events: DataFrame, days: DataFrame, aggregates: Sequence[Column],
                          hour: int | None = 12, horizons: int = 7, seed: int = 0,
                          day_id: Sequence[str] = ("patient_id", "hospital_day")) -> DataFrame:
    """Aggregates of the events in [start, start + h days] per sampled day and horizon.

    Windows without events are kept with a null window row, so counts of
    event columns give zero. Without `hour` the start is a stable random time
    within 24 h of the latest admission before the day.
    """
    day_min = F.col("hospital_day") * DAY
    if hour is not None:
        starts = days.withColumn("start_min", day_min + hour * 60)
    else:
        admissions = events.filter(F.col("code") == "[ADM]").select("patient_id", "age_min")
        # strictly before the day: a minute-valued event at most one minute earlier
        anchored = days.withColumn("__at", day_min - 1)
        from chronoline.operators.lookups import previous_event
        found = previous_event(anchored, admissions, "__at", "age_min", F.col("age_min"), "__adm",
                               ["hospital_day"])
        span = F.least(day_min - F.col("__adm"), F.lit(DAY))
        u = c.digest_uniform(c.stable_digest(seed, *day_id))
        starts = (found.filter(F.col("__adm").isNotNull())
                  .withColumn("start_min", F.col("__adm") + F.floor(u * span)).drop("__at", "__adm"))
    windows = starts.withColumn("end_min", F.col("start_min") + horizons * DAY)
    ids = [*day_id, "start_min"]
    hits = events_in_windows(events, windows.select(*ids, "end_min").distinct(),
                             closed_start=True)
    own = [n for n in hits.columns if n not in (*ids, "end_min")]
    # a placeholder row per window keeps the empty ones
    spine = windows.select(*ids).distinct()
    rows = hits.select(*ids, *own).unionByName(spine, allowMissingColumns=True)
    first = F.greatest(F.lit(1), F.ceil((F.col("age_min") - F.col("start_min")) / DAY)).cast("int")
    spread = rows.withColumn("horizon", F.explode(F.sequence(
        F.coalesce(first, F.lit(1)), F.lit(horizons))))
    return spread.groupBy(*day_id, "start_min", "horizon").agg(*aggregates)


def audit_windows(snapshots: DataFrame, horizon_days: int = 7) -> DataFrame:
    """First evaluation day of each admission, to discharge or the horizon."""
    first = snapshots.groupBy("patient_id", "admission_no").agg(
        F.min_by(F.struct("day", "eval_min", "dsc_min"), F.col("day")).alias("f"))
    return (first.select("patient_id", "admission_no", F.col("f.day").alias("day"),
                         F.col("f.eval_min").alias("start_min"),
                         F.least(F.col("f.dsc_min"), F.col("f.eval_min") + horizon_days * DAY)
                         .alias("end_min"))
            .filter(F.col("end_min") > F.col("start_min")))
