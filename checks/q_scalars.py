"""Column expressions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.define import Queries
from chronoline.functions import scalars as c

Q = Queries()

_COMP = """
round((age_min // 1440) // 365 / 120.0::double, 6) as years, round(((age_min // 1440) % 365) // 30 / 12.0::double, 6) as months,
round(((age_min // 1440) % 365) % 30 / 29.0::double, 6) as days, round((age_min % 1440) // 60 / 23.0::double, 6) as hours,
round(age_min % 60 / 59.0::double, 6) as minutes"""


@Q.add(f"select event_id, {_COMP} from ev")
def age_components(spark, sf):
    return v.ev(spark, sf).select("event_id", *[
        F.round(x, 6).alias(n) for n, x in c.age_components("age_min").items()])


@Q.add("select event_id, age_min // 1440 // 365 * 525600 + ((age_min // 1440) % 365) * 1440 + age_min % 1440 as age_min from ev")
def components_to_age(spark, sf):
    parts = v.ev(spark, sf).select("event_id", *[x.alias(n) for n, x in c.age_components("age_min").items()])
    return parts.select("event_id", c.components_to_age().alias("age_min"))


def time_bin_sql(prev: str, new: str, first: str = "0") -> str:
    return f"""cast({first} + case
 when floor(({new} - {prev}) / 1440.0) < 1 then (({new} - {prev}) % 1440) // 10
 when {new} // 1440 - {prev} // 1440 between 1 and 30 then 144 + ({new} // 1440 - {prev} // 1440 - 1) * 24 + ({new} % 1440) // 60
 when {new} // 1440 - {prev} // 1440 between 31 and 180 then 864 + ({new} // 1440 - {prev} // 1440 - 31) // 10 * 24 + ({new} % 1440) // 60
 when {new} // 1440 - {prev} // 1440 between 181 and 360 then 1224 + ({new} // 1440 - {prev} // 1440 - 181) // 30 * 24 + ({new} % 1440) // 60
 when {new} // 1440 - {prev} // 1440 between 361 and 1800 then 1368 + ({new} // 1440 - {prev} // 1440 - 361) // 180 * 24 + ({new} % 1440) // 60
 else 1560 end as int)"""


@Q.add(f"""
select o_orderkey, {time_bin_sql('prev', 'cur')} as label from (
 select o_orderkey, epoch(o_orderdate)::bigint // 60 + o_orderkey % 1440 as cur,
        lag(epoch(o_orderdate)::bigint // 60 + o_orderkey % 1440) over (partition by o_custkey
            order by epoch(o_orderdate)::bigint // 60 + o_orderkey % 1440, o_orderkey) as prev from orders)
where prev is not null""")
def time_bin_label(spark, sf):
    from chronoline.functions import ordered as o
    orders = v.table(spark, sf, "orders").withColumn(
        "cur", F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 60) + F.col("o_orderkey") % 1440)
    steps = o.ordered_scan(orders.select("o_orderkey", "o_custkey", "cur"), ["o_custkey"],
                           ["cur", "o_orderkey"], o.time_segment("cur", 365 * v.DAY),
                           {"prev": o.lag(F.col("cur"))}).filter(F.col("prev").isNotNull())
    return steps.select("o_orderkey", c.time_bin_label("prev", "cur").alias("label"))


@Q.add("""
select event_id, cast(age_min // 1440 // 365 as varchar) || 'Y/' || cast((age_min // 1440) % 365 // 30 as varchar) || 'M/'
 || cast((age_min // 1440) % 365 % 30 as varchar) || 'D ' || lpad(cast(age_min % 1440 // 60 as varchar), 2, '0') || ':'
 || lpad(cast(age_min % 60 as varchar), 2, '0') as age_text from ev""")
def age_text(spark, sf):
    return v.ev(spark, sf).select("event_id", c.age_text("age_min").alias("age_text"))


@Q.add("select event_id, age_min from ev")
def parse_age_text(spark, sf):
    return v.ev(spark, sf).select("event_id", c.age_text("age_min").alias("t")).select(
        "event_id", c.parse_age_text("t").alias("age_min"))


@Q.add(r"""
select event_id, try_cast(nullif(regexp_extract(result, '^([+-]?\d*\.?\d+(?:[eE][-+]?\d+)?)', 1), '') as double) as number from ev""")
def leading_number(spark, sf):
    return v.ev(spark, sf).select("event_id", c.leading_number("result").alias("number"))


@Q.add("""
select patient_id, age_min, event_id, cast(split_part(result, ' ', 1) as double) as "numeric" from ev
where code = 'LAB3' and result like '%mmol/L'""")
def lab_value_with_unit(spark, sf):
    value = c.lab_value("code", "result", "LAB3", "mmol/L")
    return v.ev(spark, sf).select("patient_id", "age_min", "event_id", value.alias("numeric")).filter(
        F.col("numeric").isNotNull())


@Q.add("""
select event_id, code, substr(code, 1, 1) as s1, case when length(code) > 1 then '*' || substr(code, 2, 2) else '' end as s2,
 case when length(code) > 3 then '***' || substr(code, 4, 1) else '' end as s3,
 case when length(code) > 4 then '****' || substr(code, 5, 1) else '' end as s4 from timeline""")
def segment_code(spark, sf):
    parts = c.segment_code("code", [1, 2, 1, 1])
    return v.timeline(spark, sf).select("event_id", "code", *[
        p.alias(f"s{i}") for i, p in enumerate(parts, start=1)])


@Q.add("select p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') as plain from part")
def normalize_code(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", c.normalize_code("p_brand").alias("plain"))


@Q.add("""
select record_no, case when item_code like 'Z%' then substr(item_code || '5', 1, 4) else substr(item_code, 1, 3) end as grp from diagnoses""")
def code_group(spark, sf):
    return v.diagnoses(spark, sf).select(
        "record_no", c.code_group(F.concat("item_code", F.lit(".5"))).alias("grp"))


@Q.add("""
select event_id, cast(starts_with(code, 'J01CA') or starts_with(code, 'J01DH') or starts_with(code, 'J01XB0') as int) as hit from timeline""")
def has_prefix(spark, sf):
    return v.timeline(spark, sf).select("event_id", c.has_prefix("code", ["J01CA", "J01DH", "J01XB0"])
                                        .cast("int").alias("hit"))


@Q.add("""
select patient_id, case sex when 'M' then 'male' when 'F' then 'female' end as sex from patients""")
def normalize_sex(spark, sf):
    return v.patients(spark, sf).select("patient_id", c.normalize_sex(
        F.concat(F.lit(" ["), F.lower("sex"), F.lit("]"))).alias("sex"))


@Q.add("""
select patient_id, '[' || sex || ']' as sex_token, case when cast(patient_id as bigint) % 2 = 0 then '[DSC_EXP]' else '[DSC_ALV]' end as disposition_token from patients""")
def token_from_value(spark, sf):
    return v.patients(spark, sf).select("patient_id", c.sex_token("sex").alias("sex_token"), c.disposition_token(
        (F.col("patient_id").cast("long") % 2).cast("int")).alias("disposition_token"))


@Q.add("""
select distinct p_size as idx, round(1 / (1 + exp(-(ln(1e-7 / (1 - 1e-7)) + p_size * (-2 * ln(1e-7 / (1 - 1e-7)) / 50)))), 9) as percentile,
 round(p_size / 50.0::double, 9) as step from part""")
def logit_grid(spark, sf):
    sizes = v.table(spark, sf, "part").select(F.col("p_size").alias("idx")).distinct()
    return sizes.select("idx", F.round(c.logit_quantile(F.col("idx"), 51), 9).alias("percentile"),
                        F.round(c.uniform_step(F.col("idx"), 51), 9).alias("step"))


@Q.add("""
select patient_id, md5('7|' || patient_id || '|' || cast(record_no as varchar)) as digest,
 cast('0x' || substr(md5('7|' || patient_id || '|' || cast(record_no as varchar)), 1, 7) as bigint) as seed, record_no from diagnoses""")
def stable_seed(spark, sf):
    return v.diagnoses(spark, sf).select(
        "patient_id", "record_no", c.stable_digest(7, "patient_id", "record_no").alias("digest"),
        c.stable_seed(7, "patient_id", "record_no").alias("seed"))


@Q.add("""
select distinct 'real::' || patient_id || '::admission' || cast(admission_no as varchar) as real_id,
 'simulation::' || patient_id || '::admission' || cast(admission_no as varchar) || '::day' || cast(day as varchar) || '::' || sim_id as sim_id
from simulations""")
def trajectory_ids(spark, sf):
    adm = F.concat(F.lit("admission"), F.col("admission_no").cast("string"))
    return v.simulations(spark, sf).select(
        c.real_trajectory_id("patient_id", adm).alias("real_id"),
        c.simulated_trajectory_id("patient_id", adm, "day", "sim_id").alias("sim_id")).distinct()
