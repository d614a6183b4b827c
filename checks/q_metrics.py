"""Discrimination and calibration metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.define import Queries
from checks.q_cohort import drawn_sql
from checks.q_simulation import _PROBS
from checks.tree_sql import TREE_PIECE, tree_weights_sql
from chronoline.operators import metrics as m
from chronoline.operators import resample

Q = Queries()
REPLICATES = 5

def _thresholds(source: str) -> str:
    bounds = f"(select grp, min(prob) - 1e-8::double as lo, max(prob) + 1e-8::double as hi, (max(prob) + 1e-8::double - (min(prob) - 1e-8::double)) / 99 as step from {source} group by grp)"
    return f"(select grp, k, case when k = 99 then hi else lo + k * step end as threshold from {bounds} cross join (select unnest(range(100)) as k))"


def _confusion_sql(rows: str, keys: str = "grp", weight: str = "1", source: str = "metric_input") -> str:
    return f"""(select {', '.join(f'r.{k}' for k in keys.split(', '))}, t.k, t.threshold, cast(sum({weight} * label) filter (prob >= threshold) as bigint) as tp0, cast(sum({weight} * (1 - label)) filter (prob >= threshold) as bigint) as fp0,
 cast(sum({weight} * label) as bigint) as p, cast(sum({weight} * (1 - label)) as bigint) as n from {rows} r join {_thresholds(source)} t on t.grp = r.grp group by all)"""


def _cells(conf: str, keys: str = "grp") -> str:
    return f"(select {keys}, k, threshold, coalesce(tp0, 0) as tp, coalesce(fp0, 0) as fp, p - coalesce(tp0, 0) as fn, n - coalesce(fp0, 0) as tn from {conf})"


_C = _cells(_confusion_sql("metric_input"))


def _confusion(spark, sf):
    counts = m.probability_counts(v.metric_input(spark, sf), ["grp"])
    return m.confusion_by_threshold(counts, ["grp"])


def _digits(df, *names, n=6):
    return df.withColumns({x: F.round(x, n) for x in names})


@Q.add(f"""select grp, cast(k as int) as k, round(threshold, 6) as threshold, tp, fp, fn, tn, round(tp / nullif(tp + fn, 0)::double, 6) as sensitivity, round(tn / nullif(tn + fp, 0)::double, 6) as specificity,
 round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tn / nullif(tn + fn, 0)::double, 6) as npv, round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy,
 round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 6) as f1 from {_C}""")
def confusion_by_threshold(spark, sf):
    out = m.threshold_metrics(_confusion(spark, sf))
    return _digits(out, "threshold", "sensitivity", "specificity", "precision", "npv", "accuracy", "f1")


_ROC = f"(select *, tp / (tp + fn + 1e-8::double) as tpr, fp / (fp + tn + 1e-8::double) as fpr from {_C})"


@Q.add(f"select grp, cast(k as int) as k, round(tpr, 6) as tpr, round(fpr, 6) as fpr from {_ROC}")
def roc_curve(spark, sf):
    return _digits(m.roc_curve(_confusion(spark, sf)).select("grp", "k", "tpr", "fpr"), "tpr", "fpr")


def _auroc(cells: str, keys: str) -> str:
    return f"""(select {keys}, sum((fpr - prev_x) * (tpr + prev_y) / 2) as auroc from (
 select {keys}, fpr, tpr, coalesce(lag(fpr) over w, fpr) as prev_x, coalesce(lag(tpr) over w, 0) as prev_y from (
  select *, tp / (tp + fn + 1e-8::double) as tpr, fp / (fp + tn + 1e-8::double) as fpr from {cells}) window w as (partition by {keys} order by k desc)) group by {keys})"""


def _auprc(cells: str, keys: str) -> str:
    return f"""(select {keys}, sum((rc - prev_x) * (pr + prev_y) / 2) + min(rc) as auprc from (
 select {keys}, rc, pr, coalesce(lag(rc) over w, rc) as prev_x, coalesce(lag(pr) over w, 0) as prev_y from (
  select *, tp / (tp + fn)::double as rc, tp / (tp + fp)::double as pr from {cells} where tp + fp > 0 and tp + fn > 0) window w as (partition by {keys} order by k desc)) group by {keys})"""


@Q.add(f"select grp, round(auroc, 6) as auroc from {_auroc(_C, 'grp')}")
def auroc(spark, sf):
    return _digits(m.auroc(_confusion(spark, sf), ["grp"]), "auroc")


@Q.add(f"select grp, cast(k as int) as k, round(tp / (tp + fn)::double, 6) as recall, round(tp / (tp + fp)::double, 6) as precision from {_C} where tp + fp > 0 and tp + fn > 0")
def pr_curve(spark, sf):
    return _digits(m.pr_curve(_confusion(spark, sf)).select("grp", "k", "recall", "precision"), "recall", "precision")


@Q.add(f"select grp, round(auprc, 6) as auprc from {_auprc(_C, 'grp')}")
def auprc(spark, sf):
    return _digits(m.auprc(_confusion(spark, sf), ["grp"]), "auprc")


@Q.add(f"""select grp, round(arg_min(threshold, (sqrt((1 - tpr) ** 2 + fpr ** 2), k)), 6) as corner_threshold,
 round(arg_min(threshold, (-coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), k)), 6) as f1_threshold, round(max(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0)), 6) as best_f1
 from {_ROC} group by grp""")
def best_threshold(spark, sf):
    return _digits(m.best_threshold(_confusion(spark, sf), ["grp"]), "corner_threshold", "f1_threshold", "best_f1")


_IDS = "(select cast(doc_id as varchar) as id, * exclude (doc_id) from metric_input)"
_DRAWN = drawn_sql(f"(select distinct id from {_IDS})", "id", REPLICATES)
_BOOT_ROWS = f"(select d.replicate, i.* from {_DRAWN} d join {_IDS} i using (id))"
_BOOT = _cells(_confusion_sql(_BOOT_ROWS, "replicate, grp"), "replicate, grp")


def _rows(spark, sf):
    return v.metric_input(spark, sf).withColumn("id", F.col("doc_id").cast("string"))


def _weights(spark, sf):
    return v.stage(spark, sf, "metric_weights", lambda s, d: resample.bootstrap_weights(
        _rows(s, d), REPLICATES, key="id"))


def _replicates(spark, sf):
    return v.stage(spark, sf, "metric_replicates", lambda s, d: m.bootstrap_metrics(
        _rows(s, d), _weights(s, d), "id", ["grp"]))


_AREAS = f"(select * from {_auroc(_BOOT, 'replicate, grp')} join {_auprc(_BOOT, 'replicate, grp')} using (replicate, grp))"


@Q.add(f"select replicate, grp, round(auroc, 6) as auroc, round(auprc, 6) as auprc from {_AREAS}")
def bootstrap_metrics(spark, sf):
    return _digits(_replicates(spark, sf), "auroc", "auprc").select(
        F.col("replicate").cast("long").alias("replicate"), "grp", "auroc", "auprc")


@Q.add(" union all ".join(f"""select grp, '{x}' as metric, round(avg({x}), 6) as mean, round(quantile_cont({x}, 0.025), 6) as lower,
 round(quantile_cont({x}, 0.975), 6) as upper from {_AREAS} group by grp""" for x in ("auroc", "auprc")))
def bootstrap_metric_ci(spark, sf):
    return _digits(m.bootstrap_metric_ci(_replicates(spark, sf), ["grp"]), "mean", "lower", "upper")


def _tree_cells(keys: str, prob: str, digest: str) -> str:
    return tree_weights_sql(f"select {keys}{prob} as prob, label, count(*) as units from metric_input group by all", [
        *keys.replace(" ", "").split(",")[:-1], "prob", "label"], f"md5({digest} || cast(cast(floor(prob * 1e12::double) as bigint) as varchar) || '|' || label)",
        REPLICATES, TREE_PIECE, "units")


_TREE = _cells(_confusion_sql(_tree_cells("grp, ", "prob", "'0|' || grp || '|'"), "replicate, grp", "weight"), "replicate, grp")


def _kept(spark, sf, scope):
    return lambda name, df: v.stage(spark, sf, f"{name}_{scope}", lambda s, d: df)


@Q.add(f"""select * from (with cells as materialized {_TREE} select replicate, grp, round(auroc, 6) as auroc, round(auprc, 6) as auprc
 from {_auroc("cells", "replicate, grp")} join {_auprc("cells", "replicate, grp")} using (replicate, grp))""")
def bootstrap_tree_metrics(spark, sf):
    """AUROC and AUPRC of replicates drawn from the condensed counts."""
    counts = m.probability_counts(v.metric_input(spark, sf), ["grp"])
    return _digits(m.condensed_bootstrap_metrics(
        counts, REPLICATES, ["grp"], piece=TREE_PIECE, keep=_kept(spark, sf, "by_group")), "auroc", "auprc").select(
        "replicate", "grp", "auroc", "auprc")


def _counts(spark, sf, keys=("grp",)):
    return m.probability_counts(v.metric_input(spark, sf), keys, clip=1e-4)


_CLIPPED = "(select grp, label, least(greatest(prob, 1e-4::double), (1 - 1e-4::double)) as prob from metric_input)"


@Q.add(f"""select g.grp, cast(b as int) as bin, round(b * 0.1::double + 0.05, 6) as center, count(label) as n, round(avg(label), 6) as observed
 from (select distinct grp from metric_input) g cross join (select unnest(range(10)) as b) left join {_CLIPPED} x on x.grp = g.grp
 and prob >= b * 0.1::double and (prob < (b + 1) * 0.1::double or b = 9) group by 1, 2, 3""")
def calibration_bins(spark, sf):
    return _digits(m.calibration_bins(_counts(spark, sf), ["grp"]), "center", "observed")


@Q.add(f"select grp, round(sum(label) / sum(prob), 6) as oe from {_CLIPPED} group by 1")
def oe_ratio(spark, sf):
    return _digits(m.oe_ratio(_counts(spark, sf), ["grp"]), "oe")


def _newton_sql(steps: int, source: str = _CLIPPED) -> str:
    """The refits as nested aggregations: the same steps, written in SQL."""
    data = f"(select grp, label, ln(prob / (1 - prob)) as x from {source})"
    coef = f"(select grp, 0.0::double as a, 0.0::double as i, 1.0::double as s from {source} group by grp)"
    for _ in range(steps):
        coef = f"""(select grp, a + ga / ha as a, i + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as i, s + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as s from (
 select grp, max(a) as a, max(i) as i, max(s) as s, sum(label - o) as ga, sum(o * (1 - o)) as ha, sum(label - f) as g0, sum((label - f) * x) as g1,
  sum(f * (1 - f)) as h00, sum(f * (1 - f) * x) as h01, sum(f * (1 - f) * x * x) as h11 from (
  select d.grp, label, x, a, i, s, 1 / (1 + exp(-(a + x))) as o, 1 / (1 + exp(-(i + s * x))) as f from {data} d join {coef} c on c.grp = d.grp) group by grp))"""
    return coef


@Q.add(f"select grp, round(a, 6) as citl, round(s, 6) as slope, round(i, 6) as intercept from {_newton_sql(8)}")
def logistic_recalibration(spark, sf):
    return _digits(m.logistic_recalibration(_counts(spark, sf), ["grp"]), "citl", "slope", "intercept")


def _lowess_sql(source: str, bounds: str) -> str:
    """(grp, g, x, smooth) over rows `source` and (grp, lo, hi) `bounds`."""
    grid = f"(select grp, g, lo + g * 0.005::double as x0, hi - lo as span from (select *, unnest(range(cast(ceil((hi - lo) / 0.005::double) as bigint))) as g from {bounds}))"
    near = f"""(select *, row_number() over (partition by grp, g order by d) as rk, count(*) over (partition by grp, g) as n from (
 select g.grp, g.g, x0, span, prob, label, abs(prob - x0) as d, prob - x0 as dx from {source} c join {grid} g on g.grp = c.grp))"""
    weighted = f"""(select *, case when d <= 0.001 * r then 1 else (1 - (d / r) ** 3) ** 3 end as w from (
 select *, max(d) filter (rk <= floor(0.5 * n + 1e-10)) over (partition by grp, g) as r from {near}) where d <= 0.999 * r)"""
    return f"""(select grp, g, x, case when sqrt(greatest(var, 0)) <= 0.001 * span then my else my - cov / var * mx end as smooth from (
 select grp, g, max(x0) as x, max(span) as span, sum(w * dx) / sum(w) as mx, sum(w * label) / sum(w) as my, sum(w * dx * dx) / sum(w) - (sum(w * dx) / sum(w)) ** 2 as var,
  sum(w * dx * label) / sum(w) - sum(w * dx) / sum(w) * (sum(w * label) / sum(w)) as cov from {weighted} group by 1, 2))"""


_SPAN = f"(select grp, min(prob) as lo, max(prob) as hi from {_CLIPPED} group by grp)"


@Q.add(f"select grp, cast(g as int) as g, round(x, 6) as x, round(smooth, 5) as smooth from {_lowess_sql(_CLIPPED, _SPAN)}")
def lowess_curve(spark, sf):
    # The probabilities are thousandths.
    out = m.lowess_curve(_counts(spark, sf), ["grp"], few_values=True)
    return out.select("grp", "g", F.round("x", 6).alias("x"), F.round("smooth", 5).alias("smooth"))


_CLIP = "least(greatest(prob, 1e-4::double), (1 - 1e-4::double))"
_BOOT_CLIPPED = f"(select replicate as grp, label, {_CLIP} as prob from {_BOOT_ROWS})"
_BOOT_SPAN = f"(select distinct replicate as grp, lo, hi from {_BOOT_ROWS} cross join (select min({_CLIP}) as lo, max({_CLIP}) as hi from metric_input))"
_BOOT_ITEMS = " union all ".join([
    f"select 'oe' as item, sum(label) / sum(prob) as value from boot group by grp",
    *[f"select '{name}', {x} from {_newton_sql(8, 'boot')}" for name, x in (("citl", "a"), ("slope", "s"), ("intercept", "i"))],
    """select 'bin_' || b, avg(label) from (select distinct grp from boot) g cross join (select unnest(range(10)) as b) left join boot x on x.grp = g.grp
 and prob >= b * 0.1::double and (prob < (b + 1) * 0.1::double or b = 9) group by g.grp, b""",
    f"select 'smooth_' || g, smooth from {_lowess_sql('boot', _BOOT_SPAN)}"])


@Q.add(f"""select * from (with boot as materialized {_BOOT_CLIPPED}, items as ({_BOOT_ITEMS})
select item, round(avg(value), 5) as mean, round(quantile_cont(value, 0.025), 5) as lower, round(quantile_cont(value, 0.975), 5) as upper from items group by item)""")
def bootstrap_calibration(spark, sf):
    return _digits(m.bootstrap_calibration(_rows(spark, sf), _weights(spark, sf), "id", few_values=True), "mean", "lower", "upper", n=5)


# The drawn cells, one row for each draw, for the plain SQL of the bands.
_TREE_BOOT = f"(select replicate as grp, label, prob from (select *, unnest(range(weight)) from {_tree_cells('', _CLIP, repr('0|'))}))"
_TREE_SPAN = f"(select g.grp, lo, hi from (select distinct grp from boot) g cross join (select min({_CLIP}) as lo, max({_CLIP}) as hi from metric_input))"


@Q.add(f"""select * from (with boot as materialized {_TREE_BOOT}, items as ({_BOOT_ITEMS.replace(_BOOT_SPAN, _TREE_SPAN)})
select item, round(avg(value), 5) as mean, round(quantile_cont(value, 0.025), 5) as lower, round(quantile_cont(value, 0.975), 5) as upper from items group by item)""")
def bootstrap_tree_calibration(spark, sf):
    """Calibration bands of replicates drawn from the condensed counts."""
    return _digits(m.condensed_bootstrap_calibration(
        _counts(spark, sf, ()), REPLICATES, piece=TREE_PIECE, few_values=True, keep=_kept(spark, sf, "all")), "mean", "lower", "upper", n=5)


_TASK_PROBS = f"(select task || '|' || horizon as grp, task, cast(horizon as int) as horizon, actual as label, prob from {_PROBS})"
_TASK_CELLS = _cells(_confusion_sql("probs", "task, horizon", source="probs"), "task, horizon")


@Q.add(f"""select * from (with probs as materialized {_TASK_PROBS}, cells as materialized {_TASK_CELLS},
totals as (select task, horizon, count(*) as n, cast(sum(label) as bigint) as n_events, sum(label) / nullif(sum(prob), 0) as oe from probs group by all)
select t.task, t.horizon, n, n_events, round(auroc, 6) as auroc, round(auprc, 6) as auprc, round(oe, 6) as oe from totals t
left join {_auroc("cells", "task, horizon")} a on a.task = t.task and a.horizon = t.horizon
left join {_auprc("cells", "task, horizon")} p on p.task = t.task and p.horizon = t.horizon)""")
def task_metrics(spark, sf):
    """Metrics per task and horizon of the simulated futures."""
    from checks.q_simulation import RULES
    from chronoline.operators import simeval
    from chronoline.plans.evaluate import task_metrics as run
    probs = v.stage(spark, sf, "probabilities", lambda s, d: simeval.event_probabilities(
        v.windows(s, d), v.stored_evd(s, d), v.simulated(s, d), RULES))
    return _digits(run(probs), "auroc", "auprc", "oe")
