"""Counts and statistics of codes and lab values, result tokens and bins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import views as v
from checks.define import Queries
from chronoline.functions import scalars as c
from chronoline.operators import clean, labstats, lookups, partials, vocab
from chronoline.session import shared_dir

Q = Queries()

_PERIOD = f"""(select *, cast(ts between timestamp '{v.ORDER_TRAIN[0]} 00:00:00' and timestamp '{v.ORDER_TRAIN[1]} 23:59:59' as int) as train_period,
 cast(ts between timestamp '{v.ORDER_TEST[0]} 00:00:00' and timestamp '{v.ORDER_TEST[1]} 23:59:59' as int) as test_period"""
_SIX = ", ".join(
    f"count(*) filter (split = '{s}' and {p}_period = 1) as \"{s}_ID_and_{p}_period\""
    for s in labstats.SPLITS for p in labstats.PERIODS)


def flagged(df):
    return clean.flag_periods(df, {"train_period": v.ORDER_TRAIN, "test_period": v.ORDER_TEST})


@Q.add(f"select item_code as original_value, {_SIX} from {_PERIOD} from diagnoses) left join splits using (patient_id) group by 1")
def code_counts(spark, sf):
    return labstats.code_counts(flagged(v.diagnoses(spark, sf)), v.splits(spark, sf))


@Q.add(f"""select code as original_value, {_SIX} from (select *, case when provisional = 1 then item_code || '(prov.)' else item_code end as code
 from {_PERIOD} from diagnoses)) left join splits using (patient_id) group by 1""")
def dx_code_counts(spark, sf):
    dx = labstats.with_provisional_code(flagged(v.diagnoses(spark, sf)))
    return labstats.code_counts(dx, v.splits(spark, sf))


@Q.add(f"""select item_code as original_value, {_SIX}, coalesce(any_value(item_name), item_code) as text from {_PERIOD} from diagnoses)
 left join splits using (patient_id) left join (select 'C' || lpad(cast(i as varchar), 2, '0') as item_code, 'name ' || cast(i as varchar) as item_name
 from (select unnest(range(97)) as i)) n using (item_code) group by item_code""")
def outer_count_merge(spark, sf):
    """The six counts of a code side by side, zero where there is none, with names."""
    from checks.q_clean import dx_names
    return labstats.code_counts(flagged(v.diagnoses(spark, sf)), v.splits(spark, sf),
                                names=dx_names(spark))


_NONNUM = """(select item_code, nonnumeric, count(*) as "count" from labs where "numeric" is null and nonnumeric is not null group by 1, 2)"""


@Q.add(f"select * from {_NONNUM}")
def nonnumeric_counts(spark, sf):
    return labstats.nonnumeric_counts(v.labs(spark, sf))


def mixed_counts(spark, sf):
    """All results; other texts of brands that end in 3 or more become a sign, so that both token rules run."""
    text = F.when(F.col("nonnumeric").startswith("(") | (F.substring("item_code", -1, 1) < "3"), F.col("nonnumeric")).otherwise(
        F.when(F.col("nonnumeric").isNotNull(), F.lit("(+-)")))
    return labstats.nonnumeric_counts(v.labs(spark, sf).withColumn("nonnumeric", text))


_MIXED = """(select item_code, case when nonnumeric like '(%' or substr(item_code, -1, 1) < '3' then nonnumeric else '(+-)' end as nonnumeric, count(*) as "count"
 from labs where "numeric" is null and nonnumeric is not null group by 1, 2)"""
_TOKENS = f"""(select item_code, nonnumeric, "count", case when n_preset = n then case nonnumeric when '(+)' then '[pos]' when '(-)' then '[neg]' else '[n/p]' end
  else '[top' || cast(rk as varchar) || ']' end as token from (
  select *, row_number() over (partition by item_code order by "count" desc, nonnumeric) as rk, count(*) over (partition by item_code) as n,
   count(*) filter (nonnumeric in ('(+)', '(-)', '(+-)')) over (partition by item_code) as n_preset from {_MIXED}))"""


@Q.add(f"select * from {_TOKENS}")
def rank_nonnumeric_tokens(spark, sf):
    return labstats.rank_nonnumeric_tokens(mixed_counts(spark, sf))


@Q.add(f"select t.*, u.unique_count from {_TOKENS} t join (select item_code, count(distinct token) as unique_count from {_TOKENS} group by 1) u using (item_code)")
def nonnumeric_stats(spark, sf):
    return labstats.nonnumeric_stats(mixed_counts(spark, sf))


_VALUES = """(select item_code, coalesce(unit, '') as unit, "numeric" as value from labs where "numeric" is not null)"""


def _stats_sql(trim_min: int, tail: float) -> str:
    return f"""
select item_code, unit, max(n) as "count", round(avg(cv), 6) as mean, round(max(med), 6) as med, round(stddev_pop(cv), 4) as std,
 round(quantile_cont(abs(cv - med), 0.5), 6) as mad, round(max(q3 - q1), 6) as iqr, min(value) as min, max(value) as max,
 round(max(lo), 6) as lower_limit, round(max(hi), 6) as upper_limit from (
 select v.*, m.* exclude (item_code, unit) from (
  select a.*, b.n, b.lo, b.hi, least(greatest(value, lo), hi) as cv from {_VALUES} a join (
   select item_code, unit, count(*) as n,
    case when count(*) >= {trim_min} then quantile_cont(value, {tail}) else min(value) end as lo,
    case when count(*) >= {trim_min} then quantile_cont(value, {1 - tail}) else max(value) end as hi from {_VALUES} group by 1, 2) b using (item_code, unit)) v
 join (select item_code, unit, quantile_cont(cv, 0.5) as med, quantile_cont(cv, 0.25) as q1, quantile_cont(cv, 0.75) as q3 from (
  select a.item_code, a.unit, least(greatest(value, lo), hi) as cv from {_VALUES} a join (
   select item_code, unit,
    case when count(*) >= {trim_min} then quantile_cont(value, {tail}) else min(value) end as lo,
    case when count(*) >= {trim_min} then quantile_cont(value, {1 - tail}) else max(value) end as hi from {_VALUES} group by 1, 2) b using (item_code, unit)) group by 1, 2) m using (item_code, unit))
group by item_code, unit"""


def _counts(spark, sf):
    """Counts of the values, which the statistics read several times."""
    return v.stage(spark, sf, "numeric_counts", lambda s, d: labstats.numeric_value_counts(v.labs(s, d)))


def _rounded(df):
    digits = {"std": 4}
    names = ("mean", "med", "std", "mad", "iqr", "lower_limit", "upper_limit")
    return df.withColumns({n: F.round(n, digits.get(n, 6)) for n in names})


@Q.add(_stats_sql(19999, 0.00005))
def numeric_stats(spark, sf):
    return _rounded(labstats.numeric_stats(_counts(spark, sf)))


@Q.add(_stats_sql(500, 0.01))
def numeric_stats_trimmed(spark, sf):
    """The same with a low trimming threshold, so that values are clipped."""
    return _rounded(labstats.numeric_stats(_counts(spark, sf), 1.0, 500))


_GRID = f"""(select item_code, unit, n, i as idx, value from
 (select *, row_number() over (partition by item_code, unit order by value) - 1 as rk, count(*) over (partition by item_code, unit) as n from {_VALUES}) r
 join (select i, 1 / (1 + exp(-(ln(1e-7 / (1 - 1e-7)) + i * (-2 * ln(1e-7 / (1 - 1e-7)) / 100)))) as p from (select unnest(range(101)) as i)) g
   on rk = cast(round_even((n - 1) * p, 0) as bigint))"""


@Q.add(f"select item_code, unit, n, idx, value from {_GRID}")
def percentile_grid(spark, sf):
    grid = labstats.percentile_grid(labstats.numeric_value_counts(v.labs(spark, sf)), bins=101)
    return grid.select("item_code", "unit", F.col("count").alias("n"), F.posexplode("grid").alias("idx", "value")
                       ).withColumn("idx", F.col("idx").cast("long"))


_DOMINANT = f"""(select item_code, unit from (select item_code, unit, row_number() over (partition by item_code order by count(*) desc, unit) as rn
 from {_VALUES} group by 1, 2) where rn = 1)"""


@Q.add(f"select d.item_code, d.unit, count(*) as \"count\" from {_DOMINANT} d join {_VALUES} x on x.item_code = d.item_code and x.unit = d.unit group by 1, 2")
def dominant_unit(spark, sf):
    counts = labstats.numeric_value_counts(v.labs(spark, sf)).groupBy("item_code", "unit").agg(
        F.sum("cnt").alias("count"))
    return labstats.dominant_unit(counts)


_JOINED = f"""(select l.*, n.num_count, t.nonnum_count, t.token from labs l
 left join (select item_code, unit, count(*) as num_count from {_VALUES} group by 1, 2) n on n.item_code = l.item_code and n.unit = coalesce(l.unit, '')
 left join (select item_code, nonnumeric, "count" as nonnum_count, token from {_TOKENS}) t on t.item_code = l.item_code and t.nonnumeric = l.nonnumeric)"""


def _joined(spark, sf):
    labs = v.labs(spark, sf)
    numeric = labstats.numeric_value_counts(labs).groupBy("item_code", "unit").agg(F.sum("cnt").alias("count"))
    return lookups.attach_lab_stats(labs, numeric, labstats.rank_nonnumeric_tokens(mixed_counts(spark, sf)))


@Q.add(f"select record_no, num_count, nonnum_count, token from {_JOINED}")
def attach_lab_stats(spark, sf):
    return _joined(spark, sf).select("record_no", "num_count", "nonnum_count", "token")


@Q.add(f"""
select record_no from (select record_no, row_number() over (partition by patient_id, ts, item_code
 order by coalesce(num_count, nonnum_count, -1) desc, record_no) as rn from {_JOINED}) where rn = 1""")
def dedup_lab_reports(spark, sf):
    return labstats.dedup_lab_reports(_joined(spark, sf), "ts", "record_no").select("record_no")


def _stored_grid(spark, sf):
    """The grid as a dataset build keeps it."""
    return v.stage(spark, sf, "grid", lambda s, d: labstats.percentile_grid(labstats.numeric_value_counts(v.labs(s, d)), bins=101))


@Q.add(f"""
select record_no, bin from labs left join (
 select record_no, arg_min(idx, (abs(g.value - l."numeric"), idx)) as bin from labs l join {_GRID} g
  on g.item_code = l.item_code and g.unit = coalesce(l.unit, '') where l."numeric" is not null group by 1) using (record_no)""")
def nearest_bin(spark, sf):
    labs = v.labs(spark, sf)
    grid = _stored_grid(spark, sf)
    return labstats.nearest_bins(labs, grid).select("record_no", F.col("bin").cast("long").alias("bin"))


@Q.add(f"""
select record_no, round(g.value, 5) as value, g.unit from (select record_no, item_code, line_no % 101 as b from labs) l
 join {_DOMINANT} d on d.item_code = l.item_code join {_GRID} g on g.item_code = d.item_code and g.unit = d.unit and g.idx = b""")
def bin_to_value(spark, sf):
    labs = v.labs(spark, sf)
    grid = _stored_grid(spark, sf)
    rows = labs.select("record_no", "item_code", (F.col("line_no") % 101).alias("bin"))
    out = labstats.bin_values(rows, grid)
    return out.select("record_no", "value", F.expr("substring_index(value_text, ' ', -1)").alias("unit"))


@Q.add("""
select item_code, n, cast(running as bigint) as running from (select item_code, n, sum(n) over (order by n desc, item_code rows unbounded preceding) as running,
 sum(n) over () as total from (select item_code, count(*) as n from diagnoses group by 1)) where running <= total * 0.6""")
def cumulative_coverage(spark, sf):
    counts = v.diagnoses(spark, sf).groupBy("item_code").agg(F.count(F.lit(1)).alias("n"))
    return labstats.cumulative_coverage(counts, "item_code", "n", 0.6).select("item_code", "n", "running")


@Q.add("""
select item_code, count(distinct patient_id) as n_patients, count(*) as n_rows from diagnoses group by 1""")
def rows_per_patient(spark, sf):
    return v.diagnoses(spark, sf).groupBy("item_code").agg(
        F.count_distinct("patient_id").alias("n_patients"), F.count(F.lit(1)).alias("n_rows"))


@Q.add("""
select item_code, cast(sum(n) as bigint) as n from (select item_code, provisional, count(*) as n from diagnoses group by 1, 2) group by 1""")
def merge_counts(spark, sf):
    """Three runs over increments of the records, stored one by one and merged."""
    return partials.merged(_runs(spark, sf), ["item_code"]).select("item_code", "n")


def _runs(spark, sf):
    """Stored partial statistics of the diagnoses by code and split, one run for each third of the days."""
    def make(spark, sf):
        path = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
        rows = v.diagnoses(spark, sf).join(v.splits(spark, sf), "patient_id", "left")
        for k in range(3):
            part = rows.filter(F.pmod(F.dayofyear("ts"), F.lit(3)) == k)
            partials.add_run(partials.partial_counts(part, ["item_code", "split"], "record_no", "provisional"), path, f"r{k}")
        return partials.stored_runs(spark, path)
    return v.stage(spark, sf, "runs", make)


@Q.add("""select item_code, split, count(*) as n, round(avg(record_no), 3) as mean, round(stddev_pop(record_no), 1) as std,
 count(*) filter (provisional = 0) as n_final, count(*) filter (provisional = 1) as n_provisional
 from diagnoses left join splits using (patient_id) group by all""")
def merged_runs(spark, sf):
    """Means, spreads and categories by code and split; the runs are folded into totals one after another."""
    keys, runs = ["item_code", "split"], _runs(spark, sf)
    run = lambda k: runs.filter(F.col("run") == f"r{k}").drop("run")
    totals = partials.totals_of(run(0), "r0")
    for k in (1, 2):
        totals = partials.fold(totals, run(k), f"r{k}", keys)
    of = lambda c: F.coalesce(F.try_element_at("categories", F.lit(c)), F.lit(0))
    return partials.finished(totals).select(*keys, "n", F.round("mean", 3).alias("mean"), F.round("std", 1).alias("std"),
                                            of("0").alias("n_final"), of("1").alias("n_provisional"))


@Q.add("""select item_code, count(distinct patient_id) as n_patients, true as within_error from diagnoses group by 1""")
def approx_patients(spark, sf):
    """Exact number of patients of a code, and whether the union of the stored sketches lies within 5 % and 1 of it."""
    exact = v.diagnoses(spark, sf).groupBy("item_code").agg(F.count_distinct("patient_id").alias("n_patients"))
    near = partials.finished(partials.merged(_runs(spark, sf), ["item_code"])).select("item_code", F.col("n_patients").alias("near"))
    return exact.join(near, "item_code").select(
        "item_code", "n_patients", (F.abs(F.col("near") - F.col("n_patients")) <= 1 + F.col("n_patients") * 0.05).alias("within_error"))


@Q.add("""
select brand, p_partkey, p_retailprice from (select p_brand as brand, p_partkey, p_retailprice,
 row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rn from part) where rn <= 5""")
def top_n(spark, sf):
    from chronoline.operators.cohort import top_n as run
    part = v.table(spark, sf, "part").select(F.col("p_brand").alias("brand"),
                                             F.col("p_partkey"), "p_retailprice",
                                             F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("tie"))
    return run(part, ["brand"], "p_retailprice", 5, "tie").select("brand", "p_partkey", "p_retailprice")
