"""Sources, sinks, cleaning, filters and dictionary joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views as v
from checks.define import Queries
from chronoline import fixed_values as fv
from chronoline.functions import scalars as c
from chronoline.operators import clean, lookups, timeline
from chronoline.schema import TableSpec
from chronoline.session import shared_dir
from chronoline.sources import records

Q = Queries()

LAB_SPEC = TableSpec(
    {"patient_id": T.StringType(), "timestamp": T.TimestampNTZType(), "item_code": T.StringType(),
     "numeric": T.DoubleType(), "unit": T.StringType(), "nonnumeric": T.StringType(),
     "record_no": T.StringType(), "time_available": T.TimestampNTZType()},
    ("patient_id", "timestamp", "item_code", "unit", "nonnumeric"),
    ("record_no",), {"unit": ("mg/dL",), "nonnumeric": ("(+)", "(-)")},
    optional=("time_available",), exactly_one=("numeric", "nonnumeric"))


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@Q.add("""
select patient_id, ts as timestamp, item_code, "numeric", unit, nonnumeric, record_no,
       cast(null as timestamp) as time_available
from labs""")
def read_records(spark, sf):
    labs = v.labs(spark, sf)
    path = _folder(spark, "records")
    labs.select(
        "patient_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy/MM/dd HH:mm").alias("timestamp"),
        "item_code", F.coalesce(F.col("numeric").cast("string"), F.lit("NA")).alias("numeric"),
        F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("nonnumeric", F.lit("none")).alias("nonnumeric"),
        "record_no", F.lit("dropped").alias("other_column"),
    ).write.csv(path, header=True)
    return records.read_records(spark, f"{path}/*.csv", LAB_SPEC)


@Q.add("""
select 'not_null' as rule, 'patient_id' as "column", count(*) filter (patient_id is null) as violations from labs
union all select 'not_null', 'timestamp', count(*) filter (ts is null) from labs
union all select 'not_null', 'item_code', count(*) filter (item_code is null) from labs
union all select 'not_null', 'unit', count(*) filter (unit is null) from labs
union all select 'not_null', 'nonnumeric', count(*) filter (nonnumeric is null) from labs
union all select 'allowed', 'unit', count(*) filter (unit not in ('mg/dL')) from labs
union all select 'allowed', 'nonnumeric', count(*) filter (nonnumeric not in ('(+)', '(-)')) from labs
union all select 'exactly_one', 'numeric,nonnumeric',
  count(*) filter (("numeric" is null) = (nonnumeric is null)) from labs
union all select 'unique', 'record_no', count(*) from (select record_no from labs group by 1 having count(*) > 1)
union all select 'foreign_key', 'patient_id', count(*) from labs
  where patient_id not in (select patient_id from patients)""")
def validate_table(spark, sf):
    labs = v.labs(spark, sf).withColumnRenamed("ts", "timestamp")
    return records.validate_table(labs, LAB_SPEC, v.patients(spark, sf))


@Q.add("""
select 'DX' || cast(row_number() over (order by md5(cast(record_no as varchar)), record_no) as varchar)
       as unique_record_id, record_no, item_code
from diagnoses""")
def assign_record_ids(spark, sf):
    dx = v.diagnoses(spark, sf)
    return records.assign_record_ids(dx, "diagnoses", ["record_no"]).select(
        "unique_record_id", "record_no", "item_code")


@Q.add("""
select patient_id, event_id, code from timeline
where patient_id = '7' and ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-20 12:00:00'""")
def scan_patient(spark, sf):
    events = v.evd_blocks(spark, sf).frame.filter(F.col("event_id") >= 0)
    return records.scan_patient(events, "7", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"),
                                F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"), "ts").select(
        "patient_id", "event_id", "code")


@Q.add("select patient_id, record_no from diagnoses where patient_id in (select patient_id from splits where split = 'test')")
def scan_patients(spark, sf):
    ids = v.splits(spark, sf).filter(F.col("split") == "test")
    return records.scan_patients(v.diagnoses(spark, sf), ids).select("patient_id", "record_no")


@Q.add("""select split, patient_id, count(*) as n_rows, min(record_no) as first_record, max(record_no) as last_record
from diagnoses join splits using (patient_id) group by all""")
def patient_blocks(spark, sf):
    """Records by split and patient, written in blocks, opened again and summed up without a shuffle."""
    from chronoline.sources import blocks
    path = _folder(spark, "blocks")
    rows = v.diagnoses(spark, sf).join(v.splits(spark, sf), "patient_id").select(
        "split", "patient_id", "record_no", "item_code")
    blocks.write_blocks(rows, path, ["record_no"], split="split")
    return blocks.open_blocks(spark, path).frame.groupBy("split", "patient_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("record_no").alias("first_record"), F.max("record_no").alias("last_record"))


@Q.add("select split, patient_id, record_no, item_code from diagnoses join splits using (patient_id)")
def write_dataset(spark, sf):
    rows = v.diagnoses(spark, sf).join(v.splits(spark, sf), "patient_id").select(
        "split", "patient_id", "record_no", "item_code")
    return records.write_dataset(rows, _folder(spark, "dataset"), ["split"], {"source": "orders"}).select(
        "split", "patient_id", "record_no", "item_code")


@Q.add("""
select patient_id, type, age_min, code, '' as text, result, train_period, test_period from ev""")
def read_event_view(spark, sf):
    ev = v.ev(spark, sf)
    path = _folder(spark, "event_view")
    ev.select("patient_id", "type", c.age_text("age_min").alias("age"), "code", F.lit("").alias("text"),
              "result", "train_period", "test_period").write.csv(path, header=True)
    return records.read_event_view(spark, path, age_as_text=True)


@Q.add("""
select try_cast(item_code as double) as item_code, "numeric" as "numeric", try_cast(substr(patient_id, 1, 2) as int) as patient_no,
       try_cast(nonnumeric as int) as nonnumeric
from labs""")
def conform(spark, sf):
    labs = v.labs(spark, sf).withColumn("patient_no", F.substring("patient_id", 1, 2))
    return clean.conform(labs, {"item_code": T.DoubleType(), "numeric": T.DoubleType(),
                                "patient_no": T.IntegerType(), "nonnumeric": T.IntegerType()})


@Q.add("select record_no from labs where unit is not null and \"numeric\" is not null")
def drop_missing_any(spark, sf):
    return clean.drop_missing_any(v.labs(spark, sf), ["unit", "numeric"]).select("record_no")


@Q.add("select record_no from labs where unit is not null or nonnumeric is not null")
def drop_missing_all(spark, sf):
    return clean.drop_missing_all(v.labs(spark, sf), ["unit", "nonnumeric"]).select("record_no")


@Q.add("""
select count(*) as rows_before, count(*) filter (unit is null) as null_unit,
       count(*) filter (item_code is null) as null_item_code, count(*) filter ("numeric" is null) as null_numeric,
       count(*) filter (nonnumeric is null) as null_nonnumeric,
       count(*) filter (unit is null or item_code is null or ("numeric" is null and nonnumeric is null)) as rows_missing,
       count(*) filter (not (unit is null or item_code is null or ("numeric" is null and nonnumeric is null))
                        and cast(ts as date) < date_of_birth) as negative_ages,
       count(*) filter (not (unit is null or item_code is null or ("numeric" is null and nonnumeric is null))
                        and cast(ts as date) >= date_of_birth) as rows_after
from labs left join customers using (patient_id)""")
def cleaning_report(spark, sf):
    return clean.cleaning_report(v.labs(spark, sf), v.customers(spark, sf), ["unit", "item_code"],
                                 ["numeric", "nonnumeric"])


@Q.add("select event_id, date_trunc('minute', ts) as ts from timeline")
def floor_to_minute(spark, sf):
    return clean.floor_to_minute(v.timeline(spark, sf)).select("event_id", "ts")


@Q.add("""
select record_no, date_diff('minute', cast(date_of_birth as timestamp), ts) as age_min
from diagnoses join customers using (patient_id) where cast(ts as date) >= date_of_birth""")
def with_age(spark, sf):
    return clean.with_age(v.diagnoses(spark, sf), v.customers(spark, sf)).select("record_no", "age_min")


@Q.add("""
select record_no, greatest(coalesce(date_diff('minute', cast(date_of_birth as timestamp),
       case when record_no % 3 > 0 then ts end), 0), 0) as time_available_min
from diagnoses left join customers using (patient_id)""")
def with_time_available(spark, sf):
    dx = v.diagnoses(spark, sf).withColumn("known", F.when(F.col("record_no") % 3 > 0, F.col("ts")))
    return clean.with_time_available(dx, v.customers(spark, sf), "known").select(
        "record_no", "time_available_min")


@Q.add("""
select record_no from diagnoses where patient_id in (select patient_id from splits where split = 'train')
 and ts between timestamp '1996-01-01 00:00:00' and timestamp '1999-12-31 23:59:59'""")
def filter_cohort_period(spark, sf):
    ids = v.splits(spark, sf).filter(F.col("split") == "train")
    return clean.filter_cohort_period(v.diagnoses(spark, sf), ids, "1996-01-01", "1999-12-31").select("record_no")


@Q.add("""
select record_no, cast(ts between timestamp '1995-01-01 00:00:00' and timestamp '2000-06-30 23:59:59' as int) as train_period,
       cast(ts between timestamp '2000-07-01 00:00:00' and timestamp '2001-12-31 23:59:59' as int) as test_period,
       cast(ts between timestamp '1998-01-01 00:00:00' and timestamp '1999-12-31 23:59:59' as int) as update_period
from diagnoses""")
def flag_periods(spark, sf):
    return clean.flag_periods(v.diagnoses(spark, sf), {
        "train_period": v.ORDER_TRAIN, "test_period": v.ORDER_TEST,
        "update_period": ("1998-01-01", "1999-12-31")}).select(
        "record_no", "train_period", "test_period", "update_period")


def _narrow(df):
    """Shorter periods, so that some rows fall outside both."""
    return clean.flag_periods(df, {"train_period": ("2024-01-02", "2024-01-12"),
                                   "test_period": ("2024-01-18", "2024-01-29")})


_NARROW = """(select * replace (
  cast(ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-12 23:59:59' as int) as train_period,
  cast(ts between timestamp '2024-01-18 00:00:00' and timestamp '2024-01-29 23:59:59' as int) as test_period) from evd)"""


@Q.add(f"select patient_id, event_id, type from {_NARROW} where train_period = 1 or test_period = 1 or type = 0")
def drop_out_of_period(spark, sf):
    return clean.drop_out_of_period(_narrow(v.evd(spark, sf))).select("patient_id", "event_id", "type")


@Q.add(f"""
select type, count(distinct event_id) as n_records from {_NARROW}
where train_period = 0 and test_period = 0 and type <> 0 group by type""")
def out_of_period_report(spark, sf):
    return clean.out_of_period_report(_narrow(v.evd(spark, sf)), "event_id")


@Q.add("""
select patient_id, record_no from diagnoses where patient_id in
 (select patient_id from diagnoses group by patient_id having count(*) > 5)""")
def drop_demographics_only(spark, sf):
    return clean.drop_demographics_only(v.diagnoses(spark, sf), 5).select("patient_id", "record_no")


@Q.add("""
select patient_id, event_id, split from
 (select *, case when cast(patient_id as bigint) % 10 < 7 then 'train' else 'test' end as split from evd)
where type = 0 or (split = 'test' and test_period = 1) or (split <> 'test' and train_period = 1)""")
def select_event_period(spark, sf):
    rows = v.evd(spark, sf).withColumn("split", F.when(F.col("patient_id").cast("long") % 10 < 7, "train")
                                       .otherwise("test"))
    return clean.select_event_period(rows).select("patient_id", "event_id", "split")


@Q.add("""
select s.patient_id, admission_no, day, event_id from snap s join evd e on e.patient_id = s.patient_id
 and (type = 0 or (age_min > eval_min and age_min <= eval_min + 10080))""")
def slice_window_keep_demographics(spark, sf):
    windows = v.snapshots(spark, sf).select("patient_id", "admission_no", "day", "eval_min").withColumns({
        "start_min": F.col("eval_min"), "end_min": F.col("eval_min") + 7 * v.DAY})
    return clean.slice_window_keep_demographics(v.evd(spark, sf), windows).select(
        "patient_id", "admission_no", "day", "event_id")


_KNOWN = """
select s.patient_id, admission_no, day, event_id, e.code from snap s join evd e on e.patient_id = s.patient_id
 and age_min <= eval_min and time_available_min <= eval_min"""


@Q.add(_KNOWN)
def known_before(spark, sf):
    b = v.evd_blocks(spark, sf)
    return clean.known_before(b.frame, v.snapshots(spark, sf).select(
        "patient_id", "admission_no", "day", "eval_min"), segment_minutes=b.segment_minutes).select(
        "patient_id", "admission_no", "day", "event_id", "code")


@Q.add(_KNOWN.replace("e.code", "age_min, eval_min - age_min as minutes_ago"))
def snapshot_history(spark, sf):
    rows = clean.known_before(v.evd(spark, sf), v.snapshots(spark, sf).select(
        "patient_id", "admission_no", "day", "eval_min"), segment_minutes=5 * v.DAY)
    return rows.select("patient_id", "admission_no", "day", "event_id", "age_min",
                       (F.col("eval_min") - F.col("age_min")).alias("minutes_ago"))


# ---- dictionary joins -------------------------------------------------------

def brand_map(spark, sf):
    """Token arrays of part types as code map for brands seen on small parts."""
    part = v.table(spark, sf, "part").filter(F.col("p_size") <= 25)
    first = part.groupBy("p_brand").agg(F.min("p_partkey").cast("int").alias("k"))
    return first.select(F.col("p_brand").alias("original_value"),
                        F.array(F.lit(3), F.col("k"), F.lit(0)).alias("tokens"))


@Q.add("""
select record_no, pos, tokens[pos] as token from
 (select l.record_no, case when k is null then [-2, 0, 0] else [3, k, 0] end as tokens
  from labs l left join (select p_brand, cast(min(p_partkey) as int) as k from part where p_size <= 25 group by 1) m
    on l.item_code = m.p_brand), (select unnest([1, 2, 3]) as pos)""")
def map_codes_to_tokens(spark, sf):
    mapped = lookups.map_codes_to_tokens(v.labs(spark, sf), brand_map(spark, sf), "item_code", 3)
    return mapped.select("record_no", F.posexplode("tokens").alias("p", "token")).select(
        "record_no", (F.col("p") + 1).alias("pos"), "token")


_NAMES = "(select 'C' || lpad(cast(i as varchar), 2, '0') as item_code, 'name ' || cast(i as varchar) as item_name from (select unnest(range(97)) as i))"


def dx_names(spark):
    return spark.range(97).select(
        F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("item_code"),
        F.concat(F.lit("name "), F.col("id").cast("string")).alias("item_name"))


@Q.add(f"""
select record_no, code, coalesce(case when code like '%(prov.)' then item_name || ' (prov.)' else item_name end, code) as text
from (select record_no, item_code as base, case when provisional = 1 then item_code || '(prov.)' else item_code end as code
      from diagnoses) left join {_NAMES} n on base = n.item_code""")
def map_code_names(spark, sf):
    from chronoline.operators.labstats import with_provisional_code
    dx = with_provisional_code(v.diagnoses(spark, sf)).withColumnRenamed("item_code", "code")
    return lookups.map_code_names(dx, dx_names(spark), "code", provisional=True).select(
        "record_no", "code", "text")


@Q.add("""
select event_id, code, case code when '[ADM]' then 'admitted' when '[DSC]' then 'discharged' else '' end as text from timeline""")
def map_token_names(spark, sf):
    return lookups.map_token_names(v.timeline(spark, sf), "code").select("event_id", "code", "text")


@Q.add("select record_no from diagnoses where patient_id in (select patient_id from patients)")
def keep_ids(spark, sf):
    return lookups.keep_ids(v.diagnoses(spark, sf), v.patients(spark, sf)).select("record_no")


@Q.add("select record_no from diagnoses where patient_id not in (select patient_id from patients)")
def exclude_ids(spark, sf):
    return lookups.exclude_ids(v.diagnoses(spark, sf), v.patients(spark, sf)).select("record_no")


@Q.add("""
select event_id, case when type = 1 then 'dept ' || cast(event_id % 9 as varchar) end as department from ev""")
def attach_admission_attributes(spark, sf):
    rows = v.ev(spark, sf).withColumn("unique_record_id", F.col("event_id").cast("string"))
    adm = rows.filter(F.col("type") == 1).select("unique_record_id", F.concat(
        F.lit("dept "), (F.col("event_id") % 9).cast("string")).alias("department"))
    return lookups.attach_admission_attributes(rows, adm).select("event_id", "department")


@Q.add("""
select distinct l.patient_id, a.ts as adm_ts, l.ts as lab_ts
from (select distinct cast(o_custkey as varchar) as patient_id, o_orderdate as ts from orders) a
join labs l on a.patient_id = l.patient_id join customers p on p.patient_id = a.patient_id
where a.ts >= timestamp '1996-01-01' and l.item_code in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#7', 'Brand#8') and l.nonnumeric = '(+)'
  and abs(epoch(l.ts) - epoch(a.ts)) <= 2592000 and a.ts >= p.date_of_birth + interval 20 year""")
def interval_cohort(spark, sf):
    return _cohort(spark, sf).select("patient_id", "adm_ts", "lab_ts")


def _cohort(spark, sf):
    orders = v.table(spark, sf, "orders")
    adm = orders.select(F.col("o_custkey").cast("string").alias("patient_id"),
                        F.col("o_orderdate").alias("adm_ts")).distinct()
    return lookups.interval_cohort(
        adm, v.labs(spark, sf), v.customers(spark, sf),
        ["Brand#11", "Brand#12", "Brand#13", "Brand#7", "Brand#8"], "(+)", "1996-01-01 00:00:00",
        hours=720)


@Q.add("""
select patient_id, adm_ts, lab_ts, next_ts from (
 select *, row_number() over (partition by patient_id, adm_ts order by next_ts, lab_ts) as rn from (
  select c.*, l.ts as next_ts from (
   select distinct l.patient_id, a.ts as adm_ts, l.ts as lab_ts
   from (select distinct cast(o_custkey as varchar) as patient_id, o_orderdate as ts from orders) a
   join labs l on a.patient_id = l.patient_id join customers p on p.patient_id = a.patient_id
   where a.ts >= timestamp '1996-01-01' and l.item_code in ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#7', 'Brand#8') and l.nonnumeric = '(+)'
     and abs(epoch(l.ts) - epoch(a.ts)) <= 2592000 and a.ts >= p.date_of_birth + interval 20 year) c
  join labs l on l.patient_id = c.patient_id and l.item_code = 'Brand#5' and l.ts > c.adm_ts and l.ts > c.lab_ts))
where rn = 1""")
def first_event_after(spark, sf):
    return lookups.first_event_after(_cohort(spark, sf), v.labs(spark, sf), "Brand#5",
                                     ["patient_id", "adm_ts"])


@Q.add("""
select w.patient_id, w.age_min, min(round(w.v * 1000 * n.v * 0.01, 6)) as anc from
 (select patient_id, epoch(ts)::bigint // 60 as age_min, "numeric" as v from labs where item_code = 'Brand#11' and unit = 'mg/dL' and "numeric" is not null) w
 join (select patient_id, epoch(ts)::bigint // 60 as age_min, "numeric" as v from labs where item_code in ('Brand#12', 'Brand#13', 'Brand#14') and unit = 'mg/dL' and "numeric" is not null) n
 using (patient_id, age_min) group by 1, 2""")
def neutrophil_counts(spark, sf):
    labs = v.labs(spark, sf).select(
        "patient_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("age_min"),
        F.col("item_code").alias("code"),
        F.concat(F.format_string("%.2f", "numeric"), F.lit(" "), F.coalesce("unit", F.lit(""))).alias("result"),
        "numeric")
    rules = {"wbc_code": "Brand#11", "wbc_unit": "mg/dL", "wbc_const": 1000,
             "neutrophil_codes": ("Brand#12", "Brand#13", "Brand#14"), "neutrophil_unit": "mg/dL",
             "thresholds": (100, 500)}
    return lookups.neutrophil_counts(labs.filter(F.col("numeric").isNotNull()), rules=rules).withColumn(
        "anc", F.round("anc", 6))


@Q.add("""
select source, patient_id, ts from (select 'labs' as source, patient_id, ts from labs
 union all select 'diagnoses', patient_id, ts from diagnoses)""")
def union_tables(spark, sf):
    labs = v.labs(spark, sf).withColumn("source", F.lit("labs"))
    dx = v.diagnoses(spark, sf).withColumn("source", F.lit("diagnoses"))
    return timeline.union_tables(labs, dx).select("source", "patient_id", "ts")


@Q.add("""
select patient_id, ts, item_code, count(*) over () as n_rows, min(record_no) as record_no
from labs group by patient_id, ts, item_code""".replace("count(*) over () as n_rows, ", ""))
def dedup_rows(spark, sf):
    labs = v.labs(spark, sf).select("patient_id", "ts", "item_code", "record_no")
    return timeline.dedup_rows(labs, ["patient_id", "ts", "item_code"], "record_no")


@Q.add("""
select patient_id from splits where split in ('train', 'validation')
except select patient_id from splits where split = 'validation'""")
def except_ids(spark, sf):
    s = v.splits(spark, sf)
    both = s.filter(F.col("split").isin("train", "validation"))
    return lookups.exclude_ids(both, s.filter(F.col("split") == "validation")).select("patient_id").distinct()


@Q.add("""
select distinct 'lab' as system, item_code as code from labs
union select distinct 'dx', case when provisional = 1 then item_code || '(prov.)' else item_code end from diagnoses""")
def distinct_codes(spark, sf):
    from chronoline.operators.labstats import with_provisional_code
    from chronoline.operators.vocab import distinct_codes as run
    lab = v.labs(spark, sf).select(F.lit("lab").alias("system"), F.col("item_code").alias("code"))
    dx = with_provisional_code(v.diagnoses(spark, sf)).select(
        F.lit("dx").alias("system"), F.col("item_code").alias("code"))
    return run(lab, dx)
