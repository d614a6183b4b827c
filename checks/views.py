"""Tables in record shape, derived from the given tables.

Every view exists twice: as a DataFrame function and as DuckDB SQL.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 1440
TRAIN = ("2024-01-01", "2024-01-15")
TEST = ("2024-01-16", "2024-01-30")
ORDER_TRAIN = ("1995-01-01", "2000-06-30")
ORDER_TEST = ("2000-07-01", "2001-12-31")
SIMULATIONS = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def patients(spark, sf):
    ids = table(spark, sf, "events").select("user_id").distinct()
    return ids.select(
        F.col("user_id").cast("string").alias("patient_id"),
        F.substring(F.lit("MFOUAN"), (1 + F.col("user_id") % 6).cast("int"), F.lit(1)).alias("sex"),
        F.date_add(F.lit("1930-01-01").cast("date"),
                   ((F.col("user_id") * 211) % 29000).cast("int")).alias("date_of_birth"))


def timeline(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    kind = F.col("event_type")
    s = lambda x: x.cast("string")
    dx = F.concat(F.substring(F.lit("CEIOZ"), (1 + (i * 7) % 5).cast("int"), F.lit(1)),
                  F.lpad(s(i % 100), 2, "0"), F.when(i % 4 == 0, "5").otherwise(""))
    med = F.concat(F.lit("J01"), F.substring(F.lit("CDGX"), (1 + i % 4).cast("int"), F.lit(1)),
                   F.substring(F.lit("AHB"), (1 + i % 3).cast("int"), F.lit(1)),
                   F.lpad(s(i % 13), 2, "0"))
    number = F.concat(F.format_string("%.2f", F.col("value")), F.lit(" mmol/L"))
    lab = (F.when(i % 5 != 0, number).when(i % 3 == 0, "(+)").when(i % 3 == 1, "(-)").otherwise("B"))
    return e.select(
        s(F.col("user_id")).alias("patient_id"), "event_id", "ts",
        F.when(kind == "signup", 1).when(kind == "purchase", 2).when(kind == "error", 3)
        .when(kind == "view", 4).otherwise(6).alias("type"),
        F.when(kind == "signup", "[ADM]").when(kind == "purchase", "[DSC]").when(kind == "error", dx)
        .when(kind == "view", med).otherwise(F.concat(F.lit("LAB"), s(i % 7))).alias("code"),
        F.when(kind == "purchase", F.when(i % 10 == 0, "[DSC_EXP]").otherwise("[DSC_ALV]"))
        .when(kind == "click", lab).otherwise("").alias("result"))


def ev(spark, sf):
    """Event view with ages, the time results became known, and period flags."""
    from chronoline.functions import scalars as c
    from chronoline.operators.clean import flag_periods
    t = timeline(spark, sf).join(patients(spark, sf).select("patient_id", "date_of_birth"), "patient_id")
    age = c.minutes_between(F.col("date_of_birth").cast("timestamp_ntz"), F.col("ts"))
    rows = t.withColumn("age_min", age).withColumn(
        "time_available_min", F.when(F.col("type") == 6, F.col("age_min") + F.col("event_id") % 4 * 600)
        .otherwise(F.lit(0))).drop("date_of_birth")
    return flag_periods(rows, {"train_period": TRAIN, "test_period": TEST})


def evd(spark, sf):
    """`ev` with one demographic row per patient on the day of the first event."""
    rows = ev(spark, sf)
    first = rows.groupBy("patient_id").agg(F.min("age_min").alias("a"), F.min("ts").alias("t"))
    head = first.join(patients(spark, sf), "patient_id").select(
        "patient_id", F.lit(-1).cast("long").alias("event_id"),
        F.date_trunc("day", "t").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("type"),
        F.concat(F.lit("["), "sex", F.lit("]")).alias("code"), F.lit("").alias("result"),
        (F.floor(F.col("a") / DAY) * DAY).alias("age_min"), F.lit(0).cast("long").alias("time_available_min"),
        F.lit(0).alias("train_period"), F.lit(0).alias("test_period"))
    return rows.unionByName(head)


def labs(spark, sf):
    li, o, p = (table(spark, sf, n) for n in ("lineitem", "orders", "part"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(
        p, F.col("l_partkey") == F.col("p_partkey"))
    text = (F.col("l_orderkey") + F.col("l_linenumber")) % 10 == 0
    return j.select(
        F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderdate").alias("ts"),
        F.col("p_brand").alias("item_code"),
        F.when(~text, F.col("l_extendedprice")).alias("numeric"),
        F.when(F.col("l_linestatus") == "O", "mg/dL").when(F.col("p_size") > 40, F.lit(None))
        .otherwise("mmol/L").alias("unit"),
        F.when(text, F.when(F.col("l_returnflag") == "A", F.lit("(+)"))
               .when(F.col("l_returnflag") == "N", F.lit("(-)")).otherwise(F.col("p_type"))).alias("nonnumeric"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("record_no"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"))


def diagnoses(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderdate").alias("ts"),
        F.concat(F.substring(F.lit("CEIOZ"), (1 + k % 5).cast("int"), F.lit(1)),
                 F.lpad((k % 97).cast("string"), 2, "0")).alias("item_code"),
        F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("provisional"), k.alias("record_no"))


def customers(spark, sf):
    """Birth dates for the order-based views; some customers are too young or unborn."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("patient_id"),
        F.substring(F.lit("MFOUAN"), (1 + F.col("c_custkey") % 6).cast("int"), F.lit(1)).alias("sex"),
        F.date_add(F.lit("1930-01-01").cast("date"),
                   ((F.col("c_custkey") * 211) % 25000).cast("int")).alias("date_of_birth"))


def splits(spark, sf):
    """Split of every customer by digest-free arithmetic."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.cast("string").alias("patient_id"),
        F.when(k % 10 < 7, "train").when(k % 10 < 8, "validation").otherwise("test").alias("split"))


def metric_input(spark, sf):
    lab, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    return lab.join(docs.select("doc_id", "lang"), "doc_id").select(
        "doc_id", F.col("lang").alias("grp"), F.col("quality").alias("label"),
        F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.lit(0.3) * F.col("quality")
                + ((F.col("doc_id") * 7919) % 700) / F.lit(1000.0))).alias("prob"))


def snapshots(spark, sf):
    from chronoline.operators import stays
    return stays.admission_day_snapshots(stays.complete_admissions(stored_evd(spark, sf)))


def simulations(spark, sf):
    """Simulated futures: the real ones of a window, moved in time per simulation.

    Whole tables: every event of every window goes to every simulation; some
    leave the window by the shift. One demographic row per simulation.
    """
    from chronoline.operators.clean import events_in_windows
    snaps = snapshots(spark, sf)
    spans = snaps.select("patient_id", "admission_no", "day", "eval_min").withColumns({
        "start_min": F.col("eval_min"), "end_min": F.col("eval_min") + 7 * DAY})
    real = events_in_windows(stored_evd(spark, sf).filter(F.col("type") != 0).select(
        "patient_id", "event_id", "type", "age_min", "code", "result"), spans)
    copies = F.explode(F.sequence(F.lit(0), F.lit(SIMULATIONS - 1)))
    shift = ((F.col("event_id") * 31 + F.col("i") * 17) % 5 - 1) * 700
    moved = real.withColumn("i", copies).withColumn("age_min", F.col("age_min") + shift)
    name = F.concat(F.lit("simulation"), F.col("i").cast("string"))
    cols = ["patient_id", "admission_no", "day", name.alias("sim_id"), "event_id", "type", "age_min",
            "code", "result"]
    sex = patients(spark, sf).select("patient_id", "sex")
    head = spans.join(sex, "patient_id").withColumn("i", copies).select(
        "patient_id", "admission_no", "day", name.alias("sim_id"), F.lit(-1).cast("long").alias("event_id"),
        F.lit(0).alias("type"), (F.floor(F.col("eval_min") / DAY) * DAY).alias("age_min"),
        F.concat(F.lit("["), "sex", F.lit("]")).alias("code"), F.lit("").alias("result"))
    return moved.select(*cols).unionByName(head)


_STAGES: dict = {}


def stage(spark, sf, name, make):
    """A derived table written once per session to the shared folder."""
    from chronoline.plans.create_dataset import stored_in
    from chronoline.session import shared_dir
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGES:
        folder = f"{shared_dir(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
        _STAGES[key] = stored_in(folder)(name, make(spark, sf))
    return _STAGES[key]


def stored_evd(spark, sf):
    """`evd` for the queries that read it several times."""
    return stage(spark, sf, "evd", evd)


def stored_labs(spark, sf):
    """`labs` for the queries that read it several times."""
    return stage(spark, sf, "labs", labs)


def evd_blocks(spark, sf):
    """`evd` in patient blocks."""
    from chronoline.session import shared_dir
    from chronoline.sources.blocks import write_blocks
    key = (spark.sparkContext.applicationId, sf, "evd_blocks")
    if key not in _STAGES:
        _STAGES[key] = write_blocks(evd(spark, sf), f"{shared_dir(spark).rstrip('/')}/stages-{uuid.uuid4().hex}/evd",
                                    ["age_min", "type", "event_id"])
    return _STAGES[key]


def windows(spark, sf):
    return stage(spark, sf, "snapshots", snapshots)


def simulated(spark, sf):
    return stage(spark, sf, "simulations", simulations)


def record_tables(spark, sf):
    """The events as separate record tables."""
    e = ev(spark, sf).withColumn("unique_record_id", F.concat(F.lit("E"), F.col("event_id").cast("string")))
    known = (F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 4 * 10).cast("int"))).cast("timestamp_ntz")
    e = e.withColumns({"timestamp": F.col("ts"), "time_available": F.when(F.col("type") == 6, known)})
    base = ["patient_id", "timestamp", "unique_record_id"]
    kind = lambda n: e.filter(F.col("type") == n)
    number = F.regexp_extract("result", r"^([0-9.]+) mmol", 1)
    has = number != ""
    return {
        "admissions": kind(1).select(*base),
        "discharges": kind(2).select(*base, F.when(F.col("result") == "[DSC_EXP]", 0).otherwise(1).alias("disposition")),
        "diagnoses": kind(3).select(*base, F.col("code").alias("item_code"),
                                    (F.col("event_id") % 6 == 0).cast("int").alias("provisional")),
        "prescription_orders": kind(4).select(*base, F.col("code").alias("item_code")),
        "laboratory_results": kind(6).select(
            *base, F.col("code").alias("item_code"),
            F.when(has, number).otherwise(F.lit(None)).try_cast("double").alias("numeric"),
            F.when(has, "mmol/L").alias("unit"), F.when(~has, F.col("result")).alias("nonnumeric"),
            "time_available"),
    }


def people(spark, sf):
    return patients(spark, sf).withColumn("unique_record_id", F.concat(F.lit("PT"), "patient_id"))


def ev_splits(spark, sf):
    n = F.col("patient_id").cast("long") % 10
    return patients(spark, sf).select("patient_id", F.when(n < 7, "train").when(n < 8, "validation")
                                      .otherwise("test").alias("split"))


SQL = {
    "patients": """
select cast(user_id as varchar) as patient_id,
       substr('MFOUAN', cast(1 + user_id % 6 as int), 1) as sex,
       date '1930-01-01' + cast((user_id * 211) % 29000 as int) as date_of_birth
from (select distinct user_id from events)""",
    "timeline": """
select cast(user_id as varchar) as patient_id, event_id, ts,
       case event_type when 'signup' then 1 when 'purchase' then 2
                       when 'error' then 3 when 'view' then 4 else 6 end as type,
       case event_type
         when 'signup' then '[ADM]' when 'purchase' then '[DSC]'
         when 'error' then substr('CEIOZ', cast(1 + (event_id * 7) % 5 as int), 1)
              || lpad(cast(event_id % 100 as varchar), 2, '0')
              || case when event_id % 4 = 0 then '5' else '' end
         when 'view' then 'J01' || substr('CDGX', cast(1 + event_id % 4 as int), 1)
              || substr('AHB', cast(1 + event_id % 3 as int), 1)
              || lpad(cast(event_id % 13 as varchar), 2, '0')
         else 'LAB' || cast(event_id % 7 as varchar) end as code,
       case event_type
         when 'purchase' then case when event_id % 10 = 0 then '[DSC_EXP]' else '[DSC_ALV]' end
         when 'click' then case when event_id % 5 <> 0 then printf('%.2f', value) || ' mmol/L'
                                when event_id % 3 = 0 then '(+)'
                                when event_id % 3 = 1 then '(-)' else 'B' end
         else '' end as result
from events""",
    "ev": f"""
select t.*, date_diff('minute', cast(p.date_of_birth as timestamp), date_trunc('minute', t.ts)) as age_min,
       case when type = 6
            then date_diff('minute', cast(p.date_of_birth as timestamp), date_trunc('minute', t.ts))
                 + event_id % 4 * 600 else 0 end as time_available_min,
       cast(ts between timestamp '{TRAIN[0]} 00:00:00' and timestamp '{TRAIN[1]} 23:59:59' as int) as train_period,
       cast(ts between timestamp '{TEST[0]} 00:00:00' and timestamp '{TEST[1]} 23:59:59' as int) as test_period
from timeline t join patients p using (patient_id)""",
    "evd": f"""
select patient_id, event_id, ts, type, code, result, age_min, time_available_min, train_period, test_period
from ev
union all
select patient_id, -1, date_trunc('day', min(ts)), 0, '[' || min(sex) || ']', '',
       min(age_min) // {DAY} * {DAY}, 0, 0, 0
from ev join patients using (patient_id) group by patient_id""",
    "labs": """
select cast(o_custkey as varchar) as patient_id, o_orderdate as ts,
       p_brand as item_code,
       case when (l_orderkey + l_linenumber) % 10 = 0 then null else l_extendedprice end as "numeric",
       case when l_linestatus = 'O' then 'mg/dL' when p_size > 40 then null else 'mmol/L' end as unit,
       case when (l_orderkey + l_linenumber) % 10 = 0
            then case l_returnflag when 'A' then '(+)' when 'N' then '(-)' else p_type end end as nonnumeric,
       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as record_no,
       l_orderkey * 10 + l_linenumber as line_no
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "diagnoses": """
select cast(o_custkey as varchar) as patient_id, o_orderdate as ts,
       substr('CEIOZ', cast(1 + o_orderkey % 5 as int), 1)
         || lpad(cast(o_orderkey % 97 as varchar), 2, '0') as item_code,
       case when o_orderstatus = 'P' then 1 else 0 end as provisional,
       o_orderkey as record_no
from orders""",
    "customers": """
select cast(c_custkey as varchar) as patient_id,
       substr('MFOUAN', cast(1 + c_custkey % 6 as int), 1) as sex,
       date '1930-01-01' + cast((c_custkey * 211) % 25000 as int) as date_of_birth
from customer""",
    "splits": """
select cast(c_custkey as varchar) as patient_id,
       case when c_custkey % 10 < 7 then 'train' when c_custkey % 10 < 8 then 'validation' else 'test' end as split
from customer""",
    "metric_input": """
select l.doc_id, d.lang as grp, quality as label,
       least(0.999::double, greatest(0.001::double, 0.3::double * quality
             + ((l.doc_id * 7919) % 700) / 1000.0::double)) as prob
from labels l join documents d using (doc_id)""",
    "admission_rows": """
select *, lead(code) over w as next_code, lead(age_min) over w as next_age
from evd where code in ('[ADM]', '[DSC]') and test_period = 1
window w as (partition by patient_id order by age_min, type, event_id)""",
    "complete_adm": f"""
select patient_id, row_number() over (partition by patient_id order by age_min, type, event_id) - 1 as admission_no,
       age_min as adm_min, next_age as dsc_min, age_min // {DAY} * {DAY} as adm_day_min,
       next_age // {DAY} * {DAY} as dsc_day_min
from admission_rows where code = '[ADM]' and next_code = '[DSC]'""",
    "snapshots": f"""
select * from (
  select a.*, unnest(range(cast(least((dsc_day_min - adm_day_min) // {DAY}, 30) + 1 as bigint))) as day
  from complete_adm a)
where adm_min <= adm_day_min + day * {DAY} + 720 and adm_day_min + day * {DAY} + 720 <= dsc_min""",
    "snap": f"""
select patient_id, admission_no, day, adm_day_min + day * {DAY} + 720 as eval_min, dsc_min from snapshots""",
    "simulations": f"""
select s.patient_id, admission_no, day, 'simulation' || cast(i as varchar) as sim_id, event_id, type,
       age_min + ((event_id * 31 + i * 17) % 5 - 1) * 700 as age_min, code, result
from snap s join ev e on e.patient_id = s.patient_id and e.age_min > eval_min
     and e.age_min <= eval_min + {7 * DAY}, (select unnest(range({SIMULATIONS})) as i)
union all
select s.patient_id, admission_no, day, 'simulation' || cast(i as varchar), -1, 0,
       eval_min // {DAY} * {DAY}, '[' || sex || ']', ''
from snap s join patients p using (patient_id), (select unnest(range({SIMULATIONS})) as i)""",
    "ev_splits": """
select patient_id, case when cast(patient_id as bigint) % 10 < 7 then 'train' when cast(patient_id as bigint) % 10 < 8 then 'validation' else 'test' end as split
from patients""",
    "rec": """
select e.patient_id, date_trunc('minute', ts) as ts, age_min,
       case when type = 6 then date_diff('minute', cast(date_of_birth as timestamp), date_trunc('minute', ts + to_hours(cast(event_id % 4 * 10 as bigint)))) else 0 end as time_available_min,
       'E' || cast(event_id as varchar) as rid, case type when 4 then 5 else type end as type, split, train_period,
       case when type = 3 and event_id % 6 = 0 then code || '(prov.)' else code end as code,
       case when type = 6 then try_cast(nullif(regexp_extract(result, '^([0-9.]+) mmol', 1), '') as double) end as num,
       case when type = 6 and result not like '%mmol/L' then result end as nonnum,
       case when type = 2 then result end as disposition
from ev e join patients using (patient_id) join ev_splits using (patient_id)""",
    "train_rec": "select * from rec where split = 'train' and train_period = 1",
    "nn_tokens": """
select code, nonnum, n, case when n_signs = n_all then case nonnum when '(+)' then '[pos]' when '(-)' then '[neg]' else '[n/p]' end
  else '[top' || cast(rk as varchar) || ']' end as token from (
 select *, row_number() over (partition by code order by n desc, nonnum) as rk, count(*) over (partition by code) as n_all,
  count(*) filter (nonnum in ('(+)', '(-)', '(+-)')) over (partition by code) as n_signs
 from (select code, nonnum, count(*) as n from train_rec where type = 6 and num is null group by 1, 2))""",
    "specials": """
select token, row_number() over (order by pos) - 1 as index from (
 select unnest(['[PAD]', '[DX]', '[MED]', '[LAB]', '[ADM]', '[DSC]', '[PRV]', '[EOT]', '[OOV]', '[DSC_EXP]', '[DSC_ALV]',
  '[F]', '[M]', '[O]', '[U]', '[A]', '[N]']) as token, unnest(range(17)) as pos
 union all select distinct token, case token when '[pos]' then 50 when '[neg]' then 51 else 52 end from nn_tokens where token not like '[top%'
 union all select '[top' || cast(i as varchar) || ']', 100 + i from (select unnest(range(
   (select min(cast(substr(token, 5, length(token) - 5) as int)) from nn_tokens where token like '[top%'),
   (select max(cast(substr(token, 5, length(token) - 5) as int)) from nn_tokens where token like '[top%') + 1)) as i))""",
    "codes": """
select distinct case type when 3 then 'dx' when 5 then 'med' else 'lab' end as system, case type when 3 then 0 when 5 then 1 else 2 end as sysno,
       code, case when code like '%(prov.)' then substr(code, 1, length(code) - 7) else code end as base, code like '%(prov.)' as prov
from train_rec where type in (3, 5, 6)""",
    "pieces": """
select system, sysno, code, base, prov, segment, case when piece = '' then '' else repeat('*', start) || piece end as token from (
 select *, unnest(case system when 'dx' then [substr(base, 1, 1), substr(base, 2, 2), substr(base, 4, 1)]
   when 'med' then [substr(base, 1, 3), substr(base, 4, 1), substr(base, 5, 1), substr(base, 6, 2)] else [code] end) as piece,
  unnest(case system when 'dx' then [1, 2, 3] when 'med' then [1, 2, 3, 4] else [1] end) as segment,
  unnest(case system when 'dx' then [0, 1, 3] when 'med' then [0, 3, 4, 5] else [0] end) as start from codes)""",
    "vocab": """
select system, segment, token, row_number() over (order by sysno, segment, token) - 1 + (select count(*) from specials) as index
from (select distinct system, sysno, segment, token from pieces where token <> '')""",
    "code_map0": """
select c.system, c.sysno, c.code, c.base, c.prov, case c.system when 'dx' then 1 when 'med' then 2 else 3 end as t0,
 coalesce(max(index) filter (p.segment = 1), 0) as t1, coalesce(max(index) filter (p.segment = 2), 0) as t2,
 coalesce(max(index) filter (p.segment = 3), 0) as t3, coalesce(max(index) filter (p.segment = 4), 0) as t4,
 string_agg(p.token, ',' order by p.segment) filter (p.token <> '') as joined
from codes c join pieces p on p.system = c.system and p.code = c.code
left join vocab v on v.system = p.system and v.segment = p.segment and v.token = p.token group by 1, 2, 3, 4, 5""",
    "code_map": """
select system, sysno, code, base, prov, t0, t1, case when prov and t2 = 0 then 6 else t2 end as t2,
 case when prov and t2 > 0 and t3 = 0 then 6 else t3 end as t3, case when prov and t2 > 0 and t3 > 0 and t4 = 0 then 6 else t4 end as t4,
 case system when 'dx' then '[DX],' when 'med' then '[MED],' else '[LAB],' end || joined || case when prov then ',[PRV]' else '' end as tokenized_value
from code_map0""",
    "grid": """
select code, n, i as idx, num as value from
 (select *, row_number() over (partition by code order by num) - 1 as rk, count(*) over (partition by code) as n from train_rec where num is not null) r
 join (select i, 1 / (1 + exp(-(ln(1e-7 / (1 - 1e-7)) + i * (-2 * ln(1e-7 / (1 - 1e-7)) / 50)))) as p from (select unnest(range(51)) as i)) g
   on rk = cast(round_even((n - 1) * p, 0) as bigint)""",
    "catalog": """
select row_number() over (order by grp, pos, key) - 1 as label, kind, original_value from (
 select 0 as grp, index as pos, '' as key, 'special' as kind, token as original_value from specials
 union all select 1 + sysno, 0, code, system, code from code_map
 union all select 4, i, '', 'numeric', '' from (select unnest(range(51)) as i)
 union all select 5, i, '', 'time', '' from (select unnest(range(1561)) as i))""",
    "lab_one": """
select * from (select r.*, row_number() over (partition by patient_id, age_min, r.code order by coalesce(g.n, t.n, -1) desc, rid) as rn
 from rec r left join (select code, max(n) as n from grid group by 1) g on g.code = r.code and r.num is not null
 left join nn_tokens t on t.code = r.code and t.nonnum = r.nonnum where type = 6) where rn = 1""",
    "lab_bin": """
select rid, arg_min(idx, (abs(g.value - l.num), idx)) as bin from lab_one l join grid g on g.code = l.code
where l.num is not null group by 1""",
    "seq": """
select patient_id, cast(date_of_birth as timestamp) as ts, 0 as age_min, 0 as time_available_min, 'PT' || patient_id as rid, 0 as type,
 null as code, 0 as t0, 0 as t1, 0 as t2, 0 as t3, 0 as t4, cast(null as double) as rnum, s.index as ridx, '[' || sex || ']' as rtext
from patients join specials s on s.token = '[' || sex || ']'
union all
select patient_id, ts, age_min, time_available_min, rid, type, r.code,
 case type when 1 then 4 when 2 then 5 else coalesce(m.t0, -2) end, case when type < 3 then 0 else coalesce(m.t1, 0) end,
 case when type < 3 then 0 else coalesce(m.t2, 0) end, case when type < 3 then 0 else coalesce(m.t3, 0) end, case when type < 3 then 0 else coalesce(m.t4, 0) end,
 null, coalesce(s.index, 0), disposition
from rec r left join code_map m on m.code = r.code and m.system = case type when 3 then 'dx' when 5 then 'med' end
left join specials s on s.token = r.disposition where type in (1, 2, 3, 5)
union all
select patient_id, ts, age_min, time_available_min, l.rid, type, l.code, coalesce(m.t0, -2), coalesce(m.t1, 0), 0, 0, 0,
 b.bin / 50.0::double, case when l.num is null then coalesce(s.index, -2) else 0 end,
 case when l.num is null then l.nonnum when b.bin is not null then cast(l.num as varchar) || ' mmol/L' end
from lab_one l left join code_map m on m.code = l.code and m.system = 'lab' left join lab_bin b on b.rid = l.rid
left join nn_tokens t on t.code = l.code and t.nonnum = l.nonnum left join specials s on s.token = t.token""",
    "token_rows": """
select patient_id, ts, age_min, time_available_min, original_value, type, sort_code, priority, num, t0, t1, t2, t3, t4, min(rid) as rid from (
 select patient_id, ts, age_min, time_available_min, rid, type, '' as sort_code, 0 as priority, null as original_value, null as num, 0 as t0, 0 as t1, 0 as t2, 0 as t3, 0 as t4 from seq
 union all select patient_id, ts, age_min, time_available_min, rid, type, coalesce(code, ''), 1, code, null, t0, t1, t2, t3, t4 from seq where t0 <> 0
 union all select patient_id, ts, age_min, time_available_min, rid, type, coalesce(code, ''), 2, rtext, rnum, case when rnum is null then ridx else 0 end, 0, 0, 0, 0
   from seq where rnum is not null or ridx <> 0) group by all""",
    "known_rows": "select * from token_rows where t0 <> -2",
    "tl0": f"""
select *, case when type = 0 then -1 else age_min end as sort_age from (
 select patient_id, ts, age_min, original_value, type, sort_code, priority, num, t0, t1, t2, t3, t4, min(rid) as rid from known_rows group by all)
where type = 0 or ts between timestamp '{TRAIN[0]} 00:00:00' and timestamp '{TEST[1]} 23:59:59'""",
    "tl1": """
select *, row_number() over w - 1 as row_no, count(*) over (partition by patient_id) as n,
 min(age_min) filter (type <> 0) over (partition by patient_id) as first_age,
 coalesce(last_value(case when type = 0 or original_value = '[DSC]' then 0 when original_value = '[ADM]' then 1 end ignore nulls) over (w rows between unbounded preceding and current row), 0) as state,
 coalesce(first_value(case when type = 0 or original_value = '[ADM]' then 0 when original_value = '[DSC]' then 1 end ignore nulls) over (w rows between 1 following and unbounded following), 0) as nxt
from tl0 window w as (partition by patient_id order by sort_age, type, sort_code, priority, rid)""",
    "tl": """
select patient_id, case when type = 0 then first_age // 1440 * 1440 else age_min end as age_min, original_value, type, priority, rid, num, t0, t1, t2, t3, t4, row_no,
 case when state = 1 or (nxt = 1 and type <> 0 and coalesce(original_value, '') <> '[ADM]') then 1 else 0 end as admitted
from tl1 where n > 2
union all select patient_id, age_min, '[EOT]', 7, 1, patient_id || 'EOT', null, 7, 0, 0, 0, 0, row_no + 1, state from tl1 where n > 2 and row_no = n - 1""",
}


def oracle(body: str) -> str:
    """Put the views a query needs in front of it."""
    extra = {}
    text = body
    if body.lstrip().lower().startswith("with "):
        raise ValueError("give further tables as subqueries")
    needed: list[str] = []
    names = list(SQL)
    seen, queue = set(), [text]
    while queue:
        chunk = queue.pop()
        for name in names:
            if name not in seen and re.search(rf"\b{name}\b", chunk):
                seen.add(name)
                queue.append(SQL[name])
    needed = [n for n in names if n in seen]
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in needed) + "\n" + body
