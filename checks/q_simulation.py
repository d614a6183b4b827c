"""Observed against simulated timelines, counterfactuals and plausibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.define import Queries
from chronoline.functions import scalars as c
from chronoline.operators import audit, labstats, resample, simeval, stays
from chronoline.operators.clean import slice_window_keep_demographics

Q = Queries()
DAY = 1440
WINDOW = list(simeval.WINDOW)
RULES = simeval.TaskRules(
    drugs={"glyco": (("J01XA", "J01XH"), 1), "carba": (("J01DH", "J01DB"), 1), "any_two_days": (("J01",), 2)},
    labs={"lab_one": ("LAB1", "mmol/L", (5, 20), (60, 100)), "lab_two": ("LAB2", "mmol/L", (10.0,), (50.0,))},
    creatinine={"code": "LAB3", "unit": "mmol/L", "plus": 0.3, "times": 1.5},
    neutropenia={"wbc_code": "LAB4", "wbc_unit": "mmol/L", "wbc_const": 1000, "neutrophil_codes": ("LAB4",),
                 "neutrophil_unit": "mmol/L", "thresholds": (1000, 5000)})


def _value(code: str) -> str:
    return f"case when code = '{code}' and result like '%mmol/L' then cast(split_part(result, ' ', 1) as double) end"


def _starts(*prefixes: str) -> str:
    return "(type in (4, 5) and (" + " or ".join(f"starts_with(code, '{p}')" for p in prefixes) + "))"


_DRUGS = {n: _starts(*p) for n, (p, _) in RULES.drugs.items()}
_LABS = {}
for _name, (_code, _unit, _lows, _highs) in RULES.labs.items():
    _LABS |= {f"{_name}_<_{t}_{_unit}": (f"{_value(_code)} < {t}", _value(_code)) for t in _lows}
    _LABS |= {f"{_name}_>_{t}_{_unit}": (f"{_value(_code)} > {t}", _value(_code)) for t in _highs}
_PLUS, _TIMES, _AKI = RULES.creatinine_names()
_ANC = dict(RULES.neutropenia_names())
_TASKS = ["discharge", "death", *_DRUGS, *_LABS, _PLUS, _TIMES, _AKI, *_ANC]
_K = "patient_id, admission_no, day"

_PAST = f"(select s.patient_id, admission_no, day, eval_min, age_min, event_id, type, code, result from snap s join evd e on e.patient_id = s.patient_id and type <> 0 and age_min >= eval_min - 10080 and age_min <= eval_min)"
_OBS_PARTS = [f"select {_K}, eval_min, age_min, event_id, '{n}' as task, {cond} as hit, cast(null as double) as value from {_PAST}" for n, cond in _DRUGS.items()]
_OBS_PARTS += [f"select {_K}, eval_min, age_min, event_id, '{n}', {cond}, {val} from {_PAST}" for n, (cond, val) in _LABS.items()]
_OBS_PARTS += [f"select {_K}, eval_min, age_min, event_id, '{n}', false, case when age_min >= eval_min // 1440 * 1440 then {_value('LAB3')} end from {_PAST}" for n in (_PLUS, _TIMES, _AKI)]
_OBS_PARTS += [f"select {_K}, eval_min, age_min, 0, '{n}', min(x) < {t}, min(x) from (select *, {_value('LAB4')} * 1000 * ({_value('LAB4')} * 0.01) as x from {_PAST}) where x is not null group by all" for n, t in _ANC.items()]
_OBS = f"""(select {_K}, eval_min, task, eval_min - max(age_min) filter (hit) as last_obs_min, arg_max(value, (age_min, event_id)) filter (value is not null) as last_value
 from ({' union all '.join(_OBS_PARTS)}) where coalesce(hit, false) or value is not null group by {_K}, eval_min, task)"""
_BASED = f"(select s.*, o.last_value as base_cre from snap s left join (select {_K}, last_value from {_OBS} where task = '{_AKI}') o using ({_K}))"
_MATCHED = f"""(select b.patient_id, admission_no, day, eval_min, base_cre, 'real' as sim_id, type, age_min, code, result from {_BASED} b join evd e on e.patient_id = b.patient_id and type <> 0 and age_min > eval_min and age_min <= eval_min + 10080
 union all select b.patient_id, b.admission_no, b.day, eval_min, base_cre, sim_id, type, age_min, code, result from {_BASED} b join simulations s on s.patient_id = b.patient_id and s.admission_no = b.admission_no and s.day = b.day and type <> 0 and age_min > eval_min and age_min <= eval_min + 10080)"""
_FUTURE = {"discharge": "code = '[DSC]'", "death": "result = '[DSC_EXP]'", **_DRUGS, **{n: x for n, (x, _) in _LABS.items()},
           _PLUS: f"{_value('LAB3')} >= base_cre + 0.3::double", _TIMES: f"{_value('LAB3')} >= base_cre * 1.5",
           _AKI: f"(({_value('LAB3')} >= base_cre + 0.3::double and age_min <= eval_min + 2880) or {_value('LAB3')} >= base_cre * 1.5)"}
_HIT_ROWS = " union all ".join(
    [f"select {_K}, eval_min, sim_id, age_min, '{n}' as task from {_MATCHED} where {x}" for n, x in _FUTURE.items()]
    + [f"select {_K}, eval_min, sim_id, age_min, '{n}' from (select {_K}, eval_min, sim_id, age_min, min({_value('LAB4')}) as x from {_MATCHED} group by all) where x * 1000 * (x * 0.01) < {t}" for n, t in _ANC.items()])
_HITS = f"""(select {_K}, sim_id, task, cast(ceil((ages[case when task = 'any_two_days' then 2 else 1 end] - eval_min) / 1440.0) as bigint) as hit_horizon from (
 select {_K}, eval_min, sim_id, task, list(a order by a) as ages from (select {_K}, eval_min, sim_id, task, age_min // 1440 as d, min(age_min) as a from ({_HIT_ROWS}) group by all) group by all)
 where len(ages) >= case when task = 'any_two_days' then 2 else 1 end)"""
_TASK_LIST = "(select unnest([" + ", ".join(f"'{t}'" for t in _TASKS) + "]) as task)"


def _prob_sql(windows: str, hits: str, keys: str) -> str:
    return f"""(select w.*, t.task, h as horizon, cast(coalesce(max(cast(x.sim_id = 'real' as int)), 0) as int) as actual,
  count(*) filter (x.sim_id <> 'real') / max(w.n_sim)::double as prob
 from {windows} w cross join {_TASK_LIST} t cross join (select unnest(range(1, 8)) as h)
 left join {hits} x on {' and '.join(f'x.{k} = w.{k}' for k in keys.split(', '))} and x.task = t.task and x.hit_horizon <= h
 where (base_cre is not null or t.task not in ('{_PLUS}', '{_TIMES}', '{_AKI}')) and (t.task <> '{_AKI}' or h = 7) group by all)"""


_PROBS = _prob_sql(f"(select *, {v.SIMULATIONS} as n_sim from {_BASED})", _HITS, _K)


@Q.add(f"""select patient_id, admission_no, day, sim_id, age_min, code, result, cast(ceil((age_min - eval_min) / 1440.0) as int) as horizon from {_MATCHED}""")
def window_to_events(spark, sf):
    m = simeval.window_to_events(v.windows(spark, sf), v.stored_evd(spark, sf), v.simulated(spark, sf))
    return _wide(m.select(*WINDOW, "sim_id", "age_min", "code", "result", "horizon"))


def _wide(df):
    return df.withColumns({n: F.col(n).cast("long") for n in ("admission_no", "day") if n in df.columns})


def _observed(spark, sf):
    return v.stage(spark, sf, "observed", lambda s, d: simeval.last_observations(v.windows(s, d), v.stored_evd(s, d), RULES))


def _matched(spark, sf):
    """Windows with baseline, joined to events."""
    def make(spark, sf):
        based = simeval.baseline_creatinine(v.windows(spark, sf), _observed(spark, sf), RULES)
        return simeval.window_to_events(based, v.stored_evd(spark, sf), v.simulated(spark, sf), carry=["base_cre"], order="event_id")
    return v.stage(spark, sf, "matched", make)


@Q.add(f"select patient_id, admission_no, day, task, last_obs_min, round(last_value, 6) as last_value from {_OBS}")
def last_observation(spark, sf):
    out = simeval.last_observations(v.windows(spark, sf), v.stored_evd(spark, sf), RULES)
    return _wide(out.select(*WINDOW, "task", "last_obs_min", F.round("last_value", 6).alias("last_value")))


@Q.add(f"""select p.patient_id, p.admission_no, p.day, p.task, cast(horizon as int) as horizon, actual, round(prob, 6) as prob, last_obs_min, round(last_value, 6) as last_value
 from {_PROBS} p left join {_OBS} o on o.patient_id = p.patient_id and o.admission_no = p.admission_no and o.day = p.day and o.task = p.task""")
def mc_event_probability(spark, sf):
    out = simeval.event_probabilities(v.windows(spark, sf), v.stored_evd(spark, sf), v.simulated(spark, sf), RULES)
    return _wide(out.select(*WINDOW, "task", "horizon", "actual", F.round("prob", 6).alias("prob"),
                            "last_obs_min", F.round("last_value", 6).alias("last_value")))


@Q.add(f"select patient_id, admission_no, day, sim_id, task, hit_horizon from {_HITS}")
def task_first_hits(spark, sf):
    out = simeval.task_hits(_matched(spark, sf), RULES)
    return _wide(out.select(*WINDOW, "sim_id", "task", F.col("hit_horizon").cast("long").alias("hit_horizon")))


@Q.add(f"select patient_id, admission_no, day, sim_id, hit_horizon from {_HITS} where task = '{_AKI}'")
def aki_combined(spark, sf):
    out = simeval.task_hits(_matched(spark, sf), RULES).filter(F.col("task") == _AKI)
    return _wide(out.select(*WINDOW, "sim_id", F.col("hit_horizon").cast("long").alias("hit_horizon")))


_SAMPLES = f"""(select * exclude (rn) from (select *, row_number() over (partition by {_K}, sample_size, repeat order by md5(concat_ws('|', '0', patient_id, admission_no, day, sample_size, repeat, sim_id)), sim_id) as rn
 from (select distinct {_K}, sim_id from simulations) cross join (select unnest([2, 4]) as sample_size) cross join (select unnest(range(2)) as repeat)) where rn <= sample_size)"""


def _samples(spark, sf):
    return resample.subsample_trajectories(v.simulated(spark, sf), WINDOW, [2, 4], 2)


@Q.add(f"select patient_id, admission_no, day, sample_size, repeat, sim_id from {_SAMPLES}")
def subsample_trajectories(spark, sf):
    out = _wide(_samples(spark, sf))
    return out.withColumn("repeat", F.col("repeat").cast("long"))


_MC = _prob_sql(
    f"(select b.*, s.sample_size, s.repeat, s.sample_size as n_sim from {_BASED} b join (select distinct {_K}, sample_size, repeat from {_SAMPLES}) s using ({_K}))",
    f"""(select h.*, s.sample_size, s.repeat from {_HITS} h join {_SAMPLES} s using ({_K}, sim_id)
  union all select h.*, s.sample_size, s.repeat from {_HITS} h join (select distinct {_K}, sample_size, repeat from {_SAMPLES}) s using ({_K}) where h.sim_id = 'real')""",
    f"{_K}, sample_size, repeat")


@Q.add(f"""select sample_size, repeat, task, cast(horizon as int) as horizon, actual as label, round(prob, 6) as prob, count(*) as n from {_MC} group by all""")
def mc_metric_inputs(spark, sf):
    masks = v.stage(spark, sf, "masks", lambda s, d: resample.sample_masks(v.simulated(s, d), WINDOW, [2, 4], 2))
    out = simeval.mc_metric_inputs(v.windows(spark, sf), v.stored_evd(spark, sf), v.simulated(spark, sf), masks, RULES)
    return out.select("sample_size", F.col("repeat").cast("long").alias("repeat"), "task", "horizon", "label",
                      F.round("prob", 6).alias("prob"), "n")


_SPINE = f"(select {_K}, sim_id from (select distinct {_K}, sim_id from simulations) union all select {_K}, 'real' from snap)"
_TARGETS = {"diagnosis": ["C07", "E14", "I21"], "drug": ["J01CA01", "J01XH02"], "lab": ["LAB1", "LAB2", "LAB3"]}
_KINDS = "case when type = 3 then 'diagnosis' when type in (4, 5) then 'drug' when type = 6 then 'lab' end"


def _spine(spark, sf):
    return simeval.trajectory_list(v.windows(spark, sf), v.simulated(spark, sf))


_TARGET_LIST = ", ".join(f"('{k}', '{x}')" for k, xs in _TARGETS.items() for x in xs)


@Q.add(f"""select s.patient_id, s.admission_no, s.day, s.sim_id, t.kind, t.code, count(m.code) as n from {_SPINE} s
 cross join (select * from (values {_TARGET_LIST}, ('diagnosis', null), ('drug', null), ('lab', null)) x(kind, code)) t
 left join (select *, {_KINDS} as kind from {_MATCHED}) m on m.patient_id = s.patient_id and m.admission_no = s.admission_no and m.day = s.day and m.sim_id = s.sim_id
  and m.kind = t.kind and (t.code is null or t.code = m.code) group by all""")
def patient_code_matrix(spark, sf):
    out = simeval.patient_code_counts(_matched(spark, sf), _spine(spark, sf), [*WINDOW, "sim_id"], _TARGETS)
    return _wide(out)


_LAB_CODES = ["LAB0", "LAB1", "LAB2", "LAB3", "LAB4", "LAB5", "LAB6"]
_PRESENT = ", ".join(f"coalesce(max(cast(m.code = '{x}' as int)), 0) as {x}" for x in _LAB_CODES)
_PRESENCE = f"""(select s.patient_id, s.admission_no, s.day, s.sim_id, {_PRESENT} from {_SPINE} s left join {_MATCHED} m
 on m.patient_id = s.patient_id and m.admission_no = s.admission_no and m.day = s.day and m.sim_id = s.sim_id and m.type = 6 group by all)"""


@Q.add(f"select * from {_PRESENCE}")
def lab_cooccurrence(spark, sf):
    return _wide(simeval.lab_presence(_matched(spark, sf), _spine(spark, sf), [*WINDOW, "sim_id"], _LAB_CODES))


@Q.add(" union all ".join(
    f"select '{a}' as code_1, '{b}' as code_2, cast(sum({a} * {b}) as bigint) as n_both from {_PRESENCE}"
    for i, a in enumerate(_LAB_CODES) for b in _LAB_CODES[i + 1:]))
def lab_cooccurrence_pairs(spark, sf):
    present = _matched(spark, sf).filter(F.col("type") == 6)
    return simeval.presence_pairs(present, [*WINDOW, "sim_id"], _LAB_CODES)


_BRANDS = [f"Brand#{i}" for i in range(1, 26)]
_DAYS = "epoch(ts)::bigint // 60"
_CELL = ", ".join(f"arg_min(\"numeric\", (record_no, \"numeric\")) filter (item_code = '{b}') as \"{b}\"" for b in _BRANDS)
_PIVOT = f"""(select patient_id, {_DAYS} as age_min, {_CELL} from labs where "numeric" is not null and item_code in ({', '.join(f"'{b}'" for b in _BRANDS)}) group by 1, 2)"""


def _lab_rows(spark, sf, stored=False):
    return (v.stored_labs if stored else v.labs)(spark, sf).select(
        "patient_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("age_min"),
        F.lit(6).alias("type"), F.col("item_code").alias("code"), "record_no",
        F.coalesce(F.concat(F.format_string("%.2f", "numeric"), F.lit(" "), F.coalesce("unit", F.lit(""))),
                   "nonnumeric").alias("result"), "numeric")


@Q.add(f"""select * from {_PIVOT} union all select patient_id, null{', null' * len(_BRANDS)} from customers
 where patient_id not in (select patient_id from {_PIVOT})""")
def lab_pivot(spark, sf):
    rows = _lab_rows(spark, sf).filter(F.col("numeric").isNotNull())
    return simeval.lab_pivot(rows, _BRANDS, order="record_no", fill=v.customers(spark, sf))


def _corr(a: str, b: str) -> str:
    both = f'"{a}" is not null and "{b}" is not null'
    return f"""select '{a}' as code_1, '{b}' as code_2, count(*) filter ({both}) as n,
 round(case when count(*) filter ({both}) >= 10 then corr("{a}", "{b}") filter ({both}) end, 6) as r from {_PIVOT}"""


@Q.add(" union all ".join(_corr(a, b) for i, a in enumerate(_BRANDS) for b in _BRANDS[i:]))
def correlation_matrix(spark, sf):
    rows = _lab_rows(spark, sf).filter(F.col("numeric").isNotNull())
    values = simeval.lab_values(rows, order="record_no")
    return simeval.correlation_matrix(values, codes=_BRANDS).withColumn("r", F.round("r", 6))


_NUM = "try_cast(nullif(regexp_extract(result, '^([+-]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?)', 1), '') as double)"
_ORDERED = f"""(select s.patient_id, admission_no, day, eval_min, 'real' as sim_id, event_id, type, age_min, code, result from snap s join evd e on e.patient_id = s.patient_id and type <> 0 and age_min > eval_min and age_min <= eval_min + 10080
 union all select s.patient_id, s.admission_no, s.day, eval_min, sim_id, event_id, type, age_min, code, result from snap s join simulations m on m.patient_id = s.patient_id and m.admission_no = s.admission_no and m.day = s.day and type <> 0 and age_min > eval_min and age_min <= eval_min + 10080)"""
_REACH = f"""(select {_K}, sim_id, h as reach, event_id, type, age_min, code, {_NUM} as x from {_ORDERED} cross join (select unnest(range(1, 8)) as h)
 where age_min <= eval_min + h * 1440)"""
_FIRST = ", ".join(f"arg_min(x, event_id) filter (code = '{x}') as {x}" for x in _LAB_CODES)


@Q.add(f"""select * from (with reached as {_REACH},
wide as (select {_K}, sim_id, reach, age_min, {_FIRST} from reached where type = 6 and x is not null and code in ({', '.join(f"'{x}'" for x in _LAB_CODES)}) group by all),
spine as (select {_K}, sim_id, r as reach from (select distinct {_K}, sim_id from simulations) cross join (select unnest(range(1, 8)) as r)
 union all select distinct {_K}, sim_id, reach from reached where sim_id = 'real')
select {_K}, sim_id, cast(reach as int) as reach, age_min, {', '.join(_LAB_CODES)}, case when sim_id = 'real' then 'real' else 'simulation' end as source
from spine left join wide using ({_K}, sim_id, reach))""")
def lab_distribution(spark, sf):
    return simeval.lab_distribution(_matched(spark, sf), _spine(spark, sf), _LAB_CODES)


@Q.add("""
select patient_id, count(distinct age_min) + count(nullif(code, '')) + count(nullif(result, '')) as n_tokens from evd where type <> 0 group by 1""")
def token_length(spark, sf):
    return simeval.token_lengths(v.stored_evd(spark, sf), ["patient_id"])


_LENGTHS = f"""(select {_K}, sim_id, h as horizon, count(distinct age_min) + count(nullif(code, '')) + count(nullif(result, '')) as n_tokens
 from (select s.*, h, m.age_min, m.code, m.result from {_SPINE} s cross join (select unnest(range(1, 8)) as h)
 left join {_MATCHED} m on m.patient_id = s.patient_id and m.admission_no = s.admission_no and m.day = s.day and m.sim_id = s.sim_id and m.age_min <= m.eval_min + h * 1440) group by all)"""
_LEVELS = " union all ".join(
    f"""select {_K}, horizon, {i * 5} as level, quantile_cont(n_tokens, {0.5 - 0.5 * i / 20}) filter (sim_id <> 'real') as low,
 quantile_cont(n_tokens, {0.5 + 0.5 * i / 20}) filter (sim_id <> 'real') - {0.01 if i == 0 else 0.0} as high, max(n_tokens) filter (sim_id = 'real') as n_tokens from lengths group by {_K}, horizon"""
    for i in range(21))


@Q.add(f"""select patient_id, admission_no, day, cast(horizon as int) as horizon, level, round(low, 6) as low, round(high, 6) as high, n_tokens,
 cast(round(low, 9) <= n_tokens and n_tokens <= round(high, 9) as int) as within from (with lengths as {_LENGTHS} {_LEVELS})""")
def length_calibration(spark, sf):
    lengths = simeval.horizon_lengths(_matched(spark, sf), _spine(spark, sf))
    out = simeval.length_calibration(lengths)
    return _wide(out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)}))


@Q.add(f"""select cast(horizon as int) as horizon, level, round(avg(cast(round(low, 9) <= n_tokens and n_tokens <= round(high, 9) as int)), 6) as coverage, count(*) as n_windows
 from (with lengths as {_LENGTHS} {_LEVELS}) group by 1, 2""")
def calibration_coverage(spark, sf):
    lengths = simeval.horizon_lengths(_matched(spark, sf), _spine(spark, sf))
    return simeval.calibration_coverage(simeval.length_calibration(lengths)).withColumn(
        "coverage", F.round("coverage", 6))


# ---- counterfactuals --------------------------------------------------------

@Q.add(f"""select s.patient_id, admission_no, day, event_id, shift_years, age_min + shift_years * 525600 as age_min from snap s
 join evd e on e.patient_id = s.patient_id and age_min <= eval_min and time_available_min <= eval_min cross join (select unnest([0, 5, 10, 15]) as shift_years)""")
def counterfactual_ages(spark, sf):
    from chronoline.operators.clean import known_before
    snaps = v.windows(spark, sf).select(*WINDOW, "eval_min")
    out = resample.counterfactual_variants(snaps, known_before(v.stored_evd(spark, sf), snaps), WINDOW)
    return _wide(out.select(*WINDOW, "event_id", "shift_years", "age_min"))


_CF_GRID = """(select item_code, unit, i as idx, value from
 (select *, row_number() over (partition by item_code, unit order by value) - 1 as rk, count(*) over (partition by item_code, unit) as n from
  (select item_code, coalesce(unit, '') as unit, "numeric" as value from labs where "numeric" is not null)) r
 join (select i, 1 / (1 + exp(-(ln(1e-7 / (1 - 1e-7)) + i * (-2 * ln(1e-7 / (1 - 1e-7)) / 20)))) as p from (select unnest(range(21)) as i)) g
   on rk = cast(round_even((n - 1) * p, 0) as bigint))"""
_CF_ROWS = f"""(select l.patient_id, l.record_no, l.item_code, coalesce(l.unit, '') as unit, delta, case when l.record_no = t.rid then l."numeric" + delta else l."numeric" end as x
 from labs l join (select patient_id, min(record_no) as rid, arg_min(ts, record_no) as at from labs where item_code = 'Brand#9' and "numeric" is not null group by 1) t using (patient_id)
 cross join (select unnest([-1000.0::double, 0.0::double, 1000.0::double]) as delta) where not (l.ts = t.at and l.record_no <> t.rid))"""


@Q.add(f"""select r.patient_id, r.record_no, r.delta, b.bin from {_CF_ROWS} r left join (select record_no, delta, arg_min(idx, (abs(value - x), idx)) as bin from {_CF_ROWS} r join {_CF_GRID} g using (item_code, unit) where x is not null group by 1, 2) b
 using (record_no, delta)""")
def counterfactual_lab(spark, sf):
    labs = _lab_rows(spark, sf, stored=True).join(v.stored_labs(spark, sf).select("record_no", "unit"), "record_no").withColumns({
        "unique_record_id": F.col("record_no"), "item_code": F.col("code")})
    target = (labs.filter((F.col("code") == "Brand#9") & F.col("numeric").isNotNull()).groupBy("patient_id")
              .agg(F.min_by(F.struct("unique_record_id", "age_min"), "record_no").alias("t"))
              .select("patient_id", "t.*"))
    grid = labstats.percentile_grid(labstats.numeric_value_counts(v.stored_labs(spark, sf)), bins=21)
    out = resample.counterfactual_lab(labs, target, grid, [-1000.0, 0.0, 1000.0], ["patient_id"])
    return out.select("patient_id", "record_no", "delta", F.col("bin").cast("long").alias("bin"))


# ---- plausibility -----------------------------------------------------------

SEX = audit.SexRules(pregnancy_labs=("LAB5",), female_drugs=("J01GB",), male_drugs=("J01XH", "J01DA"))
_AUDIT = """(select patient_id, admission_no, day, eval_min as start_min, least(dsc_min, eval_min + 10080) as end_min from
 (select *, row_number() over (partition by patient_id, admission_no order by day) as rn from snap) where rn = 1 and least(dsc_min, eval_min + 10080) > eval_min)"""
_TRAJ = f"""(select 'real' as source, w.patient_id, 'real::' || w.patient_id || '::' || admission_no as trajectory_id, type, code, event_id
  from {_AUDIT} w join evd e on e.patient_id = w.patient_id and (type = 0 or (age_min > start_min and age_min <= end_min))
 union all select 'simulation', w.patient_id, 'simulation::' || w.patient_id || '::' || w.admission_no || '::day' || w.day || '::' || sim_id, type, code, event_id
  from {_AUDIT} w join simulations s on s.patient_id = w.patient_id and s.admission_no = w.admission_no and s.day = w.day and (type = 0 or (age_min > start_min and age_min <= end_min)))"""


def _trajectories(spark, sf):
    def make(spark, sf):
        spans = stays.audit_windows(v.windows(spark, sf))
        real = slice_window_keep_demographics(v.stored_evd(spark, sf), spans).select(
            F.lit("real").alias("source"), "patient_id",
            c.real_trajectory_id("patient_id", "admission_no").alias("trajectory_id"), "type", "code", "event_id")
        sims = slice_window_keep_demographics(v.simulated(spark, sf), spans, WINDOW).select(
            F.lit("simulation").alias("source"), "patient_id",
            c.simulated_trajectory_id("patient_id", "admission_no", "day", "sim_id").alias("trajectory_id"),
            "type", "code", "event_id")
        return real.unionByName(sims)
    return v.stage(spark, sf, "trajectories", make)


_T = ["source", "patient_id", "trajectory_id"]
_TK = ", ".join(_T)


def _prefix_sql(codes) -> str:
    return "(" + " or ".join(f"starts_with(code, '{x}')" for x in codes) + ")"


_JUDGED = f"""(select t.*, s.sex, case when type = 3 and sex = 'male' and {_prefix_sql(SEX.female_dx)} then 'female_specific_icd_in_male'
 when type = 3 and sex = 'female' and {_prefix_sql(SEX.male_dx)} then 'male_specific_icd_in_female' when type = 6 and sex = 'male' and code = 'LAB5' then 'pregnancy_test_lab_in_male'
 when type in (4, 5) and sex = 'male' and {_prefix_sql(SEX.female_drugs)} then 'female_specific_atc_in_male'
 when type in (4, 5) and sex = 'female' and {_prefix_sql(SEX.male_drugs)} then 'male_specific_atc_in_female' end as violation_type
 from {_TRAJ} t left join (select trajectory_id, case max(code) when '[M]' then 'male' when '[F]' then 'female' end as sex from {_TRAJ} where type = 0 group by 1) s using (trajectory_id))"""
_N = {f"n_{n}_events": f"count(*) filter (violation_type = '{n}')" for n, _ in audit.VIOLATIONS}
_N |= {"n_any_sex_incompatible_icd_events": "count(*) filter (violation_type like '%icd%')",
       "n_any_sex_incompatible_atc_events": "count(*) filter (violation_type like '%atc%')",
       "n_any_sex_incompatible_events": "count(violation_type)"}
_RECORDS = f"""(select {_TK}, max(sex) as sex, count(*) filter (sex is not null and type = 3) as n_diagnosis_events, count(*) filter (sex is not null and type = 6) as n_lab_events,
 count(*) filter (sex is not null and type in (4, 5)) as n_drug_events, {', '.join(f'{e} as {n}' for n, e in _N.items())},
 {', '.join(f"cast({e} > 0 as int) as {n.replace('n_', 'has_', 1).removesuffix('_events')}" for n, e in _N.items())} from {_JUDGED} group by {_TK})"""


def _records(spark, sf):
    return audit.sex_plausibility(_trajectories(spark, sf), _T, SEX)


@Q.add(f"select * from {_RECORDS}")
def sex_plausibility(spark, sf):
    return _records(spark, sf)


_RATE = {
    "female_specific_icd_in_male_event_rate_per_diagnosis": ("n_female_specific_icd_in_male_events", "n_diagnosis_events"),
    "male_specific_icd_in_female_event_rate_per_diagnosis": ("n_male_specific_icd_in_female_events", "n_diagnosis_events"),
    "pregnancy_test_lab_in_male_event_rate_per_lab": ("n_pregnancy_test_lab_in_male_events", "n_lab_events"),
    "female_specific_atc_in_male_event_rate_per_drug": ("n_female_specific_atc_in_male_events", "n_drug_events"),
    "male_specific_atc_in_female_event_rate_per_drug": ("n_male_specific_atc_in_female_events", "n_drug_events")}
_SUMMARY = ", ".join(
    [f"cast(sum({n}) filter (sex is not null) as bigint) as {n}" for n in ("n_diagnosis_events", "n_lab_events", "n_drug_events")]
    + [f"cast(sum(has_{n}) filter (sex is not null) as bigint) as has_{n}_trajectory_count" for n in audit.FLAGS]
    + [f"cast(sum(n_{n}_events) filter (sex is not null) as bigint) as n_{n}_event_count" for n in audit.FLAGS]
    + [f"round(sum(has_{n}) filter (sex is not null) / count(sex)::double, 6) as has_{n}_trajectory_rate" for n in audit.FLAGS]
    + [f"round(sum({a}) filter (sex is not null) / nullif(sum({b}) filter (sex is not null), 0)::double, 6) as {n}" for n, (a, b) in _RATE.items()])


@Q.add(f"""select source, count(sex) as known_sex_trajectory_denominator, count(distinct patient_id) as patient_count,
 count(distinct trajectory_id) as trajectory_count, {_SUMMARY} from {_RECORDS} group by source""")
def sex_plausibility_summary(spark, sf):
    out = audit.sex_plausibility_summary(_records(spark, sf))
    return out.select(*[F.round(n, 6).alias(n) if n.endswith("_rate") or "_rate_per_" in n else F.col(n)
                        for n in out.columns])


@Q.add(f"""select v.*, denominator, round(trajectory_count / denominator::double, 6) as trajectory_rate from (
 select source, case when violation_type like '%icd%' then 'diagnosis' when violation_type like '%lab%' then 'lab' else 'drug' end as code_type, violation_type,
  case when type = 3 then case when code like 'Z%' then substr(code, 1, 4) else substr(code, 1, 3) end else code end as violating_code,
  count(*) as event_count, count(distinct trajectory_id) as trajectory_count, count(distinct patient_id) as patient_count from {_JUDGED} where violation_type is not null group by 1, 2, 3, 4) v
 join (select source, count(*) as denominator from {_RECORDS} where sex is not null group by 1) d using (source)""")
def violating_code_summary(spark, sf):
    codes = audit.violating_codes(_trajectories(spark, sf), _T, SEX)
    return audit.violating_code_summary(codes, _records(spark, sf)).withColumn(
        "trajectory_rate", F.round("trajectory_rate", 6))
