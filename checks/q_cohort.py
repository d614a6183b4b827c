"""Visit spans, splits, sampling, cohort statistics and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.define import Queries
from checks.q_windows import STAYS
from checks.tree_sql import TREE_PIECE, tree_weights_sql
from chronoline.operators import cohort, multinomial, resample, stays

Q = Queries()
REPLICATES = 10

_SPANS = """(select patient_id, min(ts) as first_visit_date, max(ts) as last_visit_date from
 (select patient_id, ts from labs union all select patient_id, ts from diagnoses) group by 1)"""


@Q.add(f"select * from {_SPANS}")
def visit_span(spark, sf):
    return cohort.visit_span(v.labs(spark, sf), v.diagnoses(spark, sf))


_SPLIT = f"""(select patient_id, case when is_test then 'test' when pos <= floor(m * 0.8::double / (0.8::double + 0.1::double)) then 'train' else 'validation' end as split from (
 select *, row_number() over (partition by is_test order by md5('0|' || patient_id), patient_id) as pos, count(*) over (partition by is_test) as m from (
  select *, g = 'test' or (g = 'both' and rk <= greatest(floor(n * (1::double - 0.8::double - 0.1::double)) - certain, 0)) as is_test from (
   select *, row_number() over (partition by g order by first_visit_date desc, patient_id) as rk, count(*) over () as n, sum(cast(g = 'test' as int)) over () as certain from (
    select *, case when last_visit_date < timestamp '2000-07-01' then 'early' when first_visit_date >= timestamp '2000-07-01' then 'test' else 'both' end as g from {_SPANS}
    where not last_visit_date < timestamp '1995-06-01' and not first_visit_date > timestamp '2001-12-31 23:59:59'
      and not (first_visit_date > timestamp '2000-05-31 23:59:59' and last_visit_date < timestamp '2000-07-01'))))))"""


@Q.add(f"select * from {_SPLIT}")
def temporal_split(spark, sf):
    return _split(spark, sf)


def _split(spark, sf):
    spans = cohort.visit_span(v.labs(spark, sf), v.diagnoses(spark, sf))
    return cohort.temporal_split(spans, ("1995-06-01", "2000-05-31"), ("2000-07-01", "2001-12-31"))


@Q.add(f"select patient_id from {_SPLIT} where split = 'validation' and patient_id in (select patient_id from diagnoses group by 1 having count(*) >= 5)")
def split_members(spark, sf):
    many = v.diagnoses(spark, sf).groupBy("patient_id").count().filter(F.col("count") >= 5)
    return cohort.split_members(_split(spark, sf), "validation", many)


@Q.add("""
select patient_id, first_age as age_min from (select patient_id, min(age_min) as first_age from evd group by 1)
where first_age // 525600 between 18 and 90""")
def ages_at_start(spark, sf):
    rows = stays.row_numbers(v.evd(spark, sf)).withColumns({"split": F.lit("train"), "included": F.lit(1)})
    return cohort.ages_at_start(rows)


_FACTS = f"""(select f.*, coalesce(n_stays, 0) as n_stays, coalesce(survived, 0) as survived, coalesce(expired, 0) as expired,
 first_age // 525600 as age_years, cast(ceil((last_age - first_age) / 1440.0) as bigint) as follow_up_days from (
 select patient_id, max(cast(code = '[M]' as int)) as men, max(cast(code = '[F]' as int)) as women, min(age_min) as first_age, max(age_min) as last_age,
  max(cast(type = 3 and regexp_matches(code, '^(C[0-8][0-9]|C9[0-7]|D0[0-9])') as int)) as cancer, max(cast(type = 3 and regexp_matches(code, '^I1[0-5]') as int)) as hypertension,
  max(cast(type = 3 and regexp_matches(code, '^E1[0-4]') as int)) as diabetes_mellitus, max(cast(type = 3 and regexp_matches(code, '^E78') as int)) as dyslipidemia from evd group by 1) f
 left join (select patient_id, count(*) as n_stays, count(*) filter (outcome = '[DSC_ALV]') as survived, count(*) filter (outcome = '[DSC_EXP]') as expired from {STAYS} group by 1) s using (patient_id))"""


def _cohort_sql(drawn: str, key: str) -> str:
    """Statistics over one row per drawn patient; `key` is a leading column or empty."""
    k = f"{key}, " if key else ""
    g = f"group by {key}" if key else ""
    facts = f"(select d.*, f.* exclude (patient_id) from {drawn} d join {_FACTS} f using (patient_id))"
    los = f"(select d.*, s.los_days from {drawn} d join {STAYS} s using (patient_id))"
    single = {
        "n_patients": "count(*)", "male_to_female": "sum(men) / nullif(sum(women), 0)::double",
        "n_admissions": "sum(n_stays)", "n_survived": "sum(survived)", "n_expired": "sum(expired)",
        "inhospital_death_rate": "round(sum(expired) / nullif(sum(n_stays), 0)::double, 4)",
        "n_cancer": "sum(cancer)", "n_hypertension": "sum(hypertension)",
        "n_diabetes_mellitus": "sum(diabetes_mellitus)", "n_dyslipidemia": "sum(dyslipidemia)"}
    parts = [f"select {k}'{n}' as statistic, cast({e} as double) as value from {facts} {g}" for n, e in single.items()]
    for name, col, src in (("age", "age_years", facts), ("period", "follow_up_days", facts), ("length_of_stay", "los_days", los)):
        for stat, fn in (("mean", "avg"), ("median", "median"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")):
            parts.append(f"select {k}'{name}_{stat}', cast({fn}({col}) as double) from {src} {g}")
    return " union all ".join(parts)


@Q.add(f"select statistic, round(value, 6) as value from ({_cohort_sql('(select distinct patient_id from evd)', '')})")
def cohort_stats(spark, sf):
    e = v.evd(spark, sf)
    return cohort.cohort_stats(e, stays.stays(e)).withColumn("value", F.round("value", 6))


_KIND = "case when type = 3 then 'dx' when type in (4, 5) then 'med' when type = 6 then 'lab' end"


@Q.add(f"select {_KIND} as kind, code, count(*) as n_records, count(distinct patient_id) as n_patients from evd where type in (3, 4, 5, 6) group by 1, 2")
def code_prevalence(spark, sf):
    return cohort.code_prevalence(v.evd(spark, sf))


def _draw(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 13) as bigint)::double / 4503599627370496.0"


def drawn_sql(ids: str, key: str, replicates: int) -> str:
    """One row per draw: (replicate, slot, key)."""
    index = f"(select {key}, row_number() over (order by md5('0|' || {key}), {key}) - 1 as idx, count(*) over () as n from {ids})"
    return f"""(select replicate, slot, i.{key} from (select replicate, s.idx as slot,
  cast(floor({_draw("concat_ws('|', '0', replicate, s.idx)")} * n) as bigint) as pick from {index} s cross join (select unnest(range({replicates})) as replicate)) d
 join {index} i on i.idx = d.pick)"""


_PEOPLE = "(select distinct patient_id from evd)"
_DRAWN = drawn_sql(_PEOPLE, "patient_id", REPLICATES)


def _weights(spark, sf):
    return resample.bootstrap_weights(v.patients(spark, sf), REPLICATES)


@Q.add(f"select replicate, patient_id, count(*) as weight from {_DRAWN} group by 1, 2")
def bootstrap_patients(spark, sf):
    return _weights(spark, sf).withColumn("replicate", F.col("replicate").cast("long"))


@Q.add(f"""
select replicate, new_id, count(*) as n_rows from (select replicate, patient_id || '_' || cast(row_number() over (partition by replicate, patient_id order by md5('0|' || cast(slot as varchar)), slot) as varchar) as new_id, patient_id from {_DRAWN})
join evd using (patient_id) group by 1, 2""")
def resample_ordinal(spark, sf):
    """Rows of every drawn patient under a new id per draw."""
    draws = resample.bootstrap_weights(v.patients(spark, sf), REPLICATES, numbered=True)
    rows = resample.bootstrap_rows(v.evd(spark, sf), draws)
    return rows.groupBy(F.col("replicate").cast("long").alias("replicate"), "new_id").agg(
        F.count(F.lit(1)).alias("n_rows"))


_TREE = tree_weights_sql("select distinct patient_id from evd", ["patient_id"], "md5('0|' || patient_id)", REPLICATES, TREE_PIECE)


def _tree(spark, sf):
    return v.stage(spark, sf, "tree_weights", lambda s, d: multinomial.bootstrap_id_weights(
        v.patients(s, d), REPLICATES, piece=TREE_PIECE))


@Q.add(f"select replicate, patient_id, weight from {_TREE}")
def bootstrap_tree_patients(spark, sf):
    """Weights of patients by the digest tree."""
    return _tree(spark, sf)


@Q.add(f"""select replicate, {_KIND} as kind, code, cast(sum(weight) as bigint) as n_records,
 cast(sum(weight) filter (first) as bigint) as n_patients from (select *, row_number() over (partition by patient_id, type, code) = 1 as first from evd where type in (3, 4, 5, 6)) e
 join {_TREE} w using (patient_id) group by 1, 2, 3""")
def bootstrap_tree_code_counts(spark, sf):
    return cohort.code_prevalence(v.evd(spark, sf), ["replicate"], _tree(spark, sf))


_BOOT = _cohort_sql(_DRAWN, "replicate")


@Q.add(f"select replicate, statistic, round(value, 6) as value from ({_BOOT})")
def bootstrap_cohort_stats(spark, sf):
    e = v.evd(spark, sf)
    weights = v.stage(spark, sf, "weights", _weights)
    return cohort.cohort_stats(e, stays.stays(e), ["replicate"], weights).select(
        F.col("replicate").cast("long").alias("replicate"), "statistic", F.round("value", 6).alias("value"))


@Q.add(f"""select statistic, round(avg(value), 6) as mean, round(quantile_cont(value, 0.025), 6) as lower, round(quantile_cont(value, 0.975), 6) as upper
 from ({_BOOT}) where value is not null group by 1""")
def bootstrap_ci(spark, sf):
    def make(spark, sf):
        e = v.evd(spark, sf)
        return cohort.cohort_stats(e, stays.stays(e), ["replicate"], v.stage(spark, sf, "weights", _weights))
    stats = v.stage(spark, sf, "bootstrap_stats", make)
    return resample.bootstrap_ci(stats, ["statistic"]).select(
        "statistic", *[F.round(n, 6).alias(n) for n in ("mean", "lower", "upper")])


@Q.add(f"""select replicate, {_KIND} as kind, code, count(*) as n_records, count(distinct slot) as n_patients from {_DRAWN} join evd using (patient_id)
 where type in (3, 4, 5, 6) group by 1, 2, 3""")
def bootstrap_code_counts(spark, sf):
    return cohort.code_prevalence(v.evd(spark, sf), ["replicate"], v.stage(spark, sf, "weights", _weights)).withColumn(
        "replicate", F.col("replicate").cast("long"))


@Q.add(f"""select replicate, type, count(*) as n_rows, round(avg(age_min), 4) as mean_age from {_DRAWN} join evd using (patient_id) group by 1, 2""")
def bootstrap_apply(spark, sf):
    w = F.col("weight")
    return resample.bootstrap_apply(v.evd(spark, sf), v.stage(spark, sf, "weights", _weights), ["type"], [
        F.sum(w).alias("n_rows"), F.round(F.sum(w * F.col("age_min")) / F.sum(w), 4).alias("mean_age")
    ]).withColumn("replicate", F.col("replicate").cast("long"))


_REAL = f"""(select replicate, {_KIND} as kind, code, count(distinct slot) as n_patients from {_DRAWN} join evd using (patient_id) where type in (3, 4, 5, 6) group by 1, 2, 3)"""
_SYN = f"""(select {_KIND} as kind, code, count(distinct (patient_id, admission_no, day, sim_id)) as n_patients from simulations where type in (3, 4, 5, 6) group by 1, 2)"""
_COMPARED = f"""(select coalesce(r.kind, s.kind) as kind, coalesce(r.code, s.code) as code, round(coalesce(s.p, 0) * 100, 6) as syn_prev, round(coalesce(real_mean, 0) * 100, 6) as real_mean,
 round(coalesce(real_lower, 0) * 100, 6) as real_lower, round(coalesce(real_upper, 0) * 100, 6) as real_upper from (
 select kind, code, avg(rate) as real_mean, quantile_cont(rate, 0.025) as real_lower, quantile_cont(rate, 0.975) as real_upper from (
  select c.kind, c.code, coalesce(n_patients, 0) / t.n_total::double as rate from (select distinct kind, code from {_REAL}) c
  cross join (select replicate, count(*) as n_total from {_DRAWN} group by 1) t left join {_REAL} x on x.kind = c.kind and x.code = c.code and x.replicate = t.replicate) group by 1, 2) r
 full join (select kind, code, n_patients / (select count(distinct (patient_id, admission_no, day, sim_id)) from simulations)::double as p from {_SYN}) s on r.kind = s.kind and r.code = s.code)"""


def _compare(spark, sf, n_shown=None):
    weights = v.stage(spark, sf, "weights", _weights)
    real = cohort.code_prevalence(v.evd(spark, sf), ["replicate"], weights)
    totals = weights.groupBy("replicate").agg(F.sum("weight").alias("n_total"))
    sims = v.simulated(spark, sf).withColumn("patient_id", F.concat_ws(
        "|", "patient_id", "admission_no", "day", "sim_id"))
    syn = cohort.code_prevalence(sims)
    n_syn = sims.agg(F.count_distinct("patient_id").alias("n_total"))
    out = cohort.prevalence_compare(real, syn, n_syn, totals, n_shown=n_shown)
    return out.select("kind", "code", *[F.round(n, 6).alias(n) for n in (
        "syn_prev", "real_mean", "real_lower", "real_upper")])


@Q.add(f"select * from {_COMPARED}")
def prevalence_compare(spark, sf):
    return _compare(spark, sf)


@Q.add("""
select o_orderkey, available from (select o_orderkey, count(*) over () as available,
 row_number() over (order by md5('0|' || cast(o_orderkey as varchar)), o_orderkey) as rn from orders) where rn <= 500""")
def draw_samples(spark, sf):
    return resample.draw_samples(v.table(spark, sf, "orders").select("o_orderkey"), 500, ["o_orderkey"])


@Q.add(f"""
select draw, o_orderkey from (select draw, cast(floor({_draw("'0|' || cast(draw as varchar)")} * (select count(*) from orders)) as bigint) + 1 as pick from (select unnest(range(2000)) as draw)) d
join (select o_orderkey, row_number() over (order by md5('0|' || cast(o_orderkey as varchar)), o_orderkey) as rn from orders) o on o.rn = d.pick""")
def draw_with_replacement(spark, sf):
    return resample.draw_with_replacement(v.table(spark, sf, "orders").select("o_orderkey"), 2000, ["o_orderkey"])


@Q.add("select count(*) as available from orders")
def available_samples(spark, sf):
    return resample.available_samples(v.table(spark, sf, "orders"))


@Q.add(f"""
select draw, patient_id, cast(floor((age_min + ({_draw("concat_ws('|', '0', draw, 'noise')")} * 2 - 1) * 0.05::double * (age_min / 525600.0::double) * 365 * 1440) / 1440) * 1440 as bigint) as age_min
from (select draw, cast(floor({_draw("'0|' || cast(draw as varchar)")} * (select count(distinct patient_id) from evd)) as bigint) + 1 as pick from (select unnest(range(1000)) as draw)) d
join (select patient_id, age_min, row_number() over (order by md5('0|' || patient_id), patient_id) as rn from (select patient_id, min(age_min) as age_min from evd group by 1)) a on a.rn = d.pick""")
def sample_ages(spark, sf):
    ages = v.evd(spark, sf).groupBy("patient_id").agg(F.min("age_min").alias("age_min"))
    return resample.sample_ages(ages, 1000)


@Q.add(f"""
select epoch, cast(draw as bigint) as draw, drawn as patient_id from (
 select 3 as epoch, p.draw, arg_max(l.patient_id, l.start) as drawn from
 (select draw, {_draw("concat_ws('|', '0', '3', draw)")} * total as x
   from (select total, unnest(range(1, cast(ceil(total) as bigint) + 1)) as draw from (select sum(least(greatest(n / 64.0::double, 1), 10)) as total from (select count(*) as n from evd group by patient_id)))) p
 join (select patient_id, coalesce(sum(w) over (order by md5('0|' || patient_id), patient_id rows between unbounded preceding and 1 preceding), 0) as start
   from (select patient_id, least(greatest(count(*) / 64.0::double, 1), 10) as w from evd group by 1)) l on l.start < p.x group by p.draw)""")
def epoch_resample(spark, sf):
    meta = v.evd(spark, sf).groupBy("patient_id").agg(F.count(F.lit(1)).alias("effective_length"))
    return resample.epoch_resample(meta, 64, 3)
