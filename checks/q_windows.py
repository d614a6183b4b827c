"""Per-patient scans: numbering, filling, stays, snapshots and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.define import Queries
from checks.q_scalars import time_bin_sql
from chronoline.functions import ordered as o
from chronoline.functions import scalars as c
from chronoline.operators import lookups, stays, timeline
from chronoline.operators.clean import events_in_windows

Q = Queries()
ORDER = ["age_min", "type", "event_id"]
W = "partition by patient_id order by age_min, type, event_id"
DAY = 1440

_FLAGS = f"""(select *, case when coalesce(last_value(case when type = 0 or code = '[DSC]' then 0 when code = '[ADM]' then 1 end ignore nulls)
   over ({W} rows between unbounded preceding and current row), 0) = 1 then 1 else 0 end as state,
  case when type <> 0 and code <> '[ADM]' and coalesce(first_value(case when type = 0 or code = '[ADM]' then 0 when code = '[DSC]' then 1 end ignore nulls)
   over ({W} rows between 1 following and unbounded following), 0) = 1 then 1 else 0 end as leaving from evd)"""

STAYS = f"""(select patient_id, age_min as adm_min, next_age as dsc_min, outcome,
   cast(ceil((next_age - age_min) / 1440.0) as bigint) as los_days
 from (select *, lead(code) over ({W}) as next_code, lead(age_min) over ({W}) as next_age, lead(result) over ({W}) as outcome
       from evd where code in ('[ADM]', '[DSC]')) where code = '[ADM]' and next_code = '[DSC]')"""


@Q.add(f"""
select p.patient_id, coalesce(n_stays, 0) as n_stays, mean_los, median_los, coalesce(n_died, 0) as n_died, events_inside, events_inside_complete
from (select patient_id, sum(greatest(state, leaving))::bigint as events_inside, sum(state * leaving)::bigint as events_inside_complete
      from {_FLAGS} group by patient_id) p
left join (select patient_id, count(*) as n_stays, round(avg(los_days), 6) as mean_los, round(median(los_days), 6) as median_los,
      count(*) filter (outcome = '[DSC_EXP]') as n_died from {STAYS} group by patient_id) s using (patient_id)""")
def flagship_stays(spark, sf):
    """In-hospital stays per patient: number, length, outcome, events inside."""
    from chronoline.plans.stay_report import stay_report
    b = v.evd_blocks(spark, sf)
    return stay_report(b.frame, b.segment_minutes)


@Q.add(f"select patient_id, event_id, row_number() over ({W}) - 1 as row_no from evd")
def row_number(spark, sf):
    b = v.evd_blocks(spark, sf)
    return stays.row_numbers(b.frame, segment_minutes=b.segment_minutes).select("patient_id", "event_id", "row_no")


@Q.add(f"""
select patient_id, event_id, case when type = 0 then min(age_min) filter (type <> 0) over (partition by patient_id) // 1440 * 1440 else age_min end as age_min,
 case when type = 0 then date_trunc('day', min(ts) filter (type <> 0) over (partition by patient_id)) else ts end as ts from evd""")
def backfill_demographic_time(spark, sf):
    rows = v.evd(spark, sf).withColumn("age_min", F.when(F.col("type") == 0, F.lit(0)).otherwise(F.col("age_min")))
    return stays.backfill_demographic_time(rows).select("patient_id", "event_id", "age_min", "ts")


@Q.add(f"""
select patient_id, event_id, last_value(case when code like 'LAB%' then event_id end ignore nulls)
 over ({W} rows between unbounded preceding and current row) as last_lab from evd""")
def forward_fill(spark, sf):
    rows = v.evd(spark, sf).withColumn("last_lab", F.when(F.col("code").startswith("LAB"), F.col("event_id")))
    return stays.forward_fill(rows, "last_lab").select("patient_id", "event_id", "last_lab")


@Q.add(f"select patient_id, event_id, greatest(state, leaving) as admitted from {_FLAGS}")
def flag_admitted(spark, sf):
    b = v.evd_blocks(spark, sf)
    return stays.flag_admitted(b.frame, segment_minutes=b.segment_minutes).select("patient_id", "event_id", "admitted")


@Q.add(f"select patient_id, event_id, state * leaving as admitted from {_FLAGS}")
def flag_admitted_complete(spark, sf):
    return stays.flag_admitted(v.evd(spark, sf), ignore_truncated=True).select(
        "patient_id", "event_id", "admitted")


@Q.add(f"select * from {STAYS}")
def admission_edges(spark, sf):
    b = v.evd_blocks(spark, sf)
    return stays.stays(b.frame, segment_minutes=b.segment_minutes)


@Q.add("select * from complete_adm")
def complete_admissions(spark, sf):
    b = v.evd_blocks(spark, sf)
    return stays.complete_admissions(b.frame, segment_minutes=b.segment_minutes).withColumn(
        "admission_no", F.col("admission_no").cast("long"))


@Q.add(f"""
select patient_id, event_id, age_min - lag(age_min) over ({W}) as step_min, {time_bin_sql('prev', 'age_min', '100')} as label
from (select *, lag(age_min) over ({W}) as prev from evd)""")
def time_delta_lag(spark, sf):
    rows = o.ordered_scan(v.evd(spark, sf), ["patient_id"], ORDER, o.time_segment("age_min", 7 * DAY),
                          {"prev": o.lag(F.col("age_min"))})
    label = F.when(F.col("prev").isNotNull(), c.time_bin_label("prev", "age_min", 100))
    return rows.select("patient_id", "event_id", (F.col("age_min") - F.col("prev")).alias("step_min"),
                       F.coalesce(label, F.lit(1660)).alias("label"))


@Q.add(f"""
select patient_id, event_id, part, result from (
 select *, case when lead(rid) over w = rid then lead(value) over w else '' end as result, lag(rid) over w as prev_rid
 from (select patient_id, age_min, type, event_id, 'R' || event_id as rid, 1 as part, code as value from evd
       union all select patient_id, age_min, type, event_id, 'R' || event_id, 2, result from evd where result <> '')
 window w as (partition by patient_id order by age_min, type, event_id, part))
where prev_rid is null or prev_rid <> rid""")
def pair_code_result(spark, sf):
    e = v.evd(spark, sf).withColumn("unique_record_id", F.concat(F.lit("R"), F.col("event_id").cast("string")))
    keep = ["patient_id", "age_min", "type", "event_id", "unique_record_id"]
    rows = e.select(*keep, F.lit(1).alias("part"), F.col("code").alias("value")).unionByName(
        e.filter(F.col("result") != "").select(*keep, F.lit(2).alias("part"), F.col("result").alias("value")))
    return timeline.pair_code_result(rows, [*ORDER, "part"], "value").select(
        "patient_id", "event_id", "part", "result")


@Q.add("""
select patient_id, min(age_min) as first_age_min from evd group by patient_id
having min(age_min) // 525600 between 30 and 60""")
def first_last_per_patient(spark, sf):
    from chronoline.operators.cohort import first_age_between
    return first_age_between(v.evd(spark, sf), 30, 60)


@Q.add(f"""
select patient_id, event_id, code, type, row_no from (select patient_id, event_id, code, type, row_number() over ({W}) - 1 as row_no from evd)
union all
select patient_id, event_id, '[EOT]', 7, row_no + 1 from (select *, row_number() over ({W}) - 1 as row_no, count(*) over (partition by patient_id) as n from evd)
where row_no = n - 1""")
def append_end_row(spark, sf):
    return timeline.append_end_row(stays.row_numbers(v.evd(spark, sf))).select(
        "patient_id", "event_id", "code", "type", "row_no")


@Q.add(f"""
select patient_id, event_id from (select *, lag(type) over ({W}) as before from evd)
where not (type in (3, 4) and before is not null and before in (3, 4))""")
def drop_repeated_time_rows(spark, sf):
    """Diagnoses and orders play the time rows."""
    return timeline.drop_repeated_time_rows(v.evd(spark, sf), ORDER, F.col("type").isin(3, 4)).select(
        "patient_id", "event_id")


@Q.add(f"""
select patient_id, event_id, row_number() over (order by patient_id, age_min, type, code, event_id) as position from evd""")
def simulation_order(spark, sf):
    """Global order by patient, age, type and code, numbered piece by piece."""
    return o.global_row_number(v.evd(spark, sf), "patient_id", ["age_min", "type", "code", "event_id"],
                               o.time_segment("age_min", 7 * DAY)).select("patient_id", "event_id", "position")


@Q.add("""
select a.patient_id, a.age_min as adm_min, min(d.age_min) as dsc_min
from (select distinct patient_id, age_min from evd where code = '[ADM]') a
join evd d on d.patient_id = a.patient_id and d.code = '[DSC]' and d.age_min >= a.age_min group by 1, 2""")
def pair_admissions(spark, sf):
    return lookups.pair_admissions(v.evd(spark, sf))


@Q.add("select patient_id, admission_no, day, eval_min from snap")
def admission_day_snapshots(spark, sf):
    return v.snapshots(spark, sf).select("patient_id", F.col("admission_no").cast("long").alias("admission_no"),
                                         F.col("day").cast("long").alias("day"), "eval_min")


_PAIRS = """(select a.patient_id, a.age_min as adm_min, min(d.age_min) as dsc_min
from (select distinct patient_id, age_min from evd where code = '[ADM]') a
join evd d on d.patient_id = a.patient_id and d.code = '[DSC]' and d.age_min >= a.age_min group by 1, 2)"""
_DAYS = f"""(select patient_id, adm_min, unnest(range(s, e + 1)) as hospital_day from
 (select patient_id, adm_min, adm_min // 1440 + cast(adm_min % 1440 > 720 as int) as s,
         dsc_min // 1440 - cast(dsc_min % 1440 < 720 as int) as e from {_PAIRS}) where e >= s)"""


@Q.add(f"select patient_id, adm_min, hospital_day from {_DAYS}")
def inpatient_day_table(spark, sf):
    return stays.inpatient_day_table(v.evd(spark, sf), hour=12).select(
        "patient_id", "adm_min", "hospital_day")


@Q.add(f"""
select d.patient_id, hospital_day, hospital_day * 1440 + 720 as start_min, h as horizon, count(event_id) as n_events,
 count(event_id) filter (type = 6) as n_labs, max(age_min) as last_age
from (select distinct patient_id, hospital_day from {_DAYS}) d cross join (select unnest(range(1, 8)) as h)
left join (select * from evd where type <> 0) e on e.patient_id = d.patient_id and age_min >= hospital_day * 1440 + 720 and age_min <= hospital_day * 1440 + 720 + h * 1440
group by 1, 2, 3, 4""")
def baseline_distribution(spark, sf):
    e = v.stored_evd(spark, sf).filter(F.col("type") != 0)
    days = stays.inpatient_day_table(v.stored_evd(spark, sf), hour=12).select(
        "patient_id", "hospital_day").distinct()
    return stays.baseline_distribution(e, days, [
        F.count("event_id").alias("n_events"),
        F.count(F.when(F.col("type") == 6, F.col("event_id"))).alias("n_labs"),
        F.max("age_min").alias("last_age")])


@Q.add("""
select patient_id, admission_no, day, start_min, end_min from (
 select patient_id, admission_no, day, eval_min as start_min, least(dsc_min, eval_min + 10080) as end_min,
  row_number() over (partition by patient_id, admission_no order by day) as rn from snap) where rn = 1 and end_min > start_min""")
def audit_windows(spark, sf):
    return stays.audit_windows(v.snapshots(spark, sf))


@Q.add("""
select s.patient_id, admission_no, day, event_id from snap s join ev e on e.patient_id = s.patient_id
 and age_min > eval_min and age_min <= eval_min + 10080""")
def window_range_join(spark, sf):
    spans = v.snapshots(spark, sf).select("patient_id", "admission_no", "day", "eval_min").withColumns({
        "start_min": F.col("eval_min"), "end_min": F.col("eval_min") + 7 * DAY})
    return events_in_windows(v.ev(spark, sf), spans).select("patient_id", "admission_no", "day", "event_id")


@Q.add("""
select s.patient_id, admission_no, day, arg_max(event_id, (age_min, type, event_id)) as latest_lab
from snap s join ev e on e.patient_id = s.patient_id and e.type = 6 and e.age_min <= s.eval_min group by 1, 2, 3""")
def previous_event(spark, sf):
    """As-of join: the latest lab record at or before each snapshot."""
    labs = v.ev(spark, sf).filter(F.col("type") == 6)
    found = lookups.previous_event(v.snapshots(spark, sf), labs, "eval_min", "age_min", F.col("event_id"),
                                   "latest_lab", ["admission_no", "day"], tie=["type", "event_id"])
    return found.filter(F.col("latest_lab").isNotNull()).select("patient_id", "admission_no", "day", "latest_lab")


@Q.add(f"""
select rule, count(*) as n_rows from (
 select unnest([case when row_no = 0 and kind <> 'sex' then 'sex_first' end,
  case when row_no = 2 and age_min - prev_age >= 1440 then 'first_step_within_a_day' end,
  case when prev = 'lab' and kind <> 'result' then 'lab_needs_result' end,
  case when kind = 'result' and prev <> 'lab' then 'result_needs_lab' end,
  case when kind = 'time' and prev = 'time' then 'time_after_time' end,
  case when kind = 'adm' and inside = 1 then 'admission_while_inside' end,
  case when kind = 'dsc' and inside = 0 then 'discharge_while_outside' end]) as rule from (
  select *, coalesce(lag(kind) over ({W}), '') as prev, coalesce(lag(age_min) over ({W}), age_min) as prev_age,
   coalesce(last_value(case kind when 'adm' then 1 when 'dsc' then 0 end ignore nulls) over ({W} rows between unbounded preceding and 1 preceding), 0) as inside
  from (select *, row_number() over ({W}) - 1 as row_no, case type when 0 then 'sex' when 1 then 'adm' when 2 then 'dsc' when 3 then 'time' when 4 then 'lab' else 'result' end as kind from evd)))
where rule is not null group by rule""")
def timeline_rules_check(spark, sf):
    """Orders play lab codes and clicks play results."""
    rows = stays.row_numbers(v.evd(spark, sf)).withColumn("kind", c.map_literal("type", {
        0: "sex", 1: "adm", 2: "dsc", 3: "time", 4: "lab", 6: "result"}))
    return timeline.timeline_rules_check(rows, ORDER)
