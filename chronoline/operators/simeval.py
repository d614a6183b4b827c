"""Observed against simulated timelines over snapshot windows.

A window is (patient_id, admission_no, day, eval_min). Simulated rows carry
the window keys and a `sim_id`. Rows are condensed to one hit age per
(window, simulation, task) once; horizons are read off that age.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import scalars as c
from chronoline.operators import resample
from chronoline.operators.clean import events_in_windows
from chronoline.operators.lookups import neutrophil_counts

DAY = 1440
WINDOW = ("patient_id", "admission_no", "day")
REAL = "real"
PAIR_TILE = 64
TRAJECTORY_KINDS = {"diagnosis": (fv.DIAGNOSIS,), "drug": fv.MEDICATION_TYPES, "lab": (fv.LAB,)}


@dataclass(frozen=True)
class TaskRules:
    """Event tasks: drug prefixes, lab thresholds, creatinine and neutrophil rules."""

    drugs: dict = field(default_factory=lambda: fv.DRUG_TASKS)
    labs: dict = field(default_factory=lambda: fv.LAB_TASKS)
    creatinine: dict = field(default_factory=lambda: fv.CREATININE)
    neutropenia: dict = field(default_factory=lambda: fv.NEUTROPENIA)

    def _lab_tests(self) -> list[tuple[str, Column]]:
        tests = []
        for name, (code, unit, lows, highs) in self.labs.items():
            value = c.lab_value("code", "result", code, unit)
            tests += [(f"{name}_<_{t}_{unit}", value < t) for t in lows]
            tests += [(f"{name}_>_{t}_{unit}", value > t) for t in highs]
        return tests

    def _drug_tests(self) -> list[tuple[str, Column]]:
        drug = F.col("type").isin(*fv.MEDICATION_TYPES)
        return [(name, drug & c.has_prefix("code", prefixes))
                for name, (prefixes, _) in self.drugs.items()]

    def creatinine_value(self) -> Column:
        return c.lab_value("code", "result", self.creatinine["code"], self.creatinine["unit"])

    def creatinine_names(self) -> tuple[str, str, str]:
        r = self.creatinine
        return (f"serum_creatinine_surge_+_{r['plus']}_{r['unit']}",
                f"serum_creatinine_surge_*_{r['times']}", "acute_kidney_injury")

    def neutropenia_names(self) -> list[tuple[str, float]]:
        return [(f"neutropenia_<_{t}_/μL", t) for t in self.neutropenia["thresholds"]]

    def past_tests(self) -> list[tuple[str, Column]]:
        return self._drug_tests() + self._lab_tests()

    def future_tests(self) -> list[tuple[str, Column]]:
        """(task, row condition); creatinine rules read `base_cre` and `eval_min`."""
        value, base = self.creatinine_value(), F.col("base_cre")
        plus, times, aki = self.creatinine_names()
        high = value >= base + self.creatinine["plus"]
        double = value >= base * self.creatinine["times"]
        soon = F.col("age_min") <= F.col("eval_min") + 2 * DAY
        return [("discharge", F.col("code") == "[DSC]"), ("death", F.col("result") == "[DSC_EXP]"),
                *self.past_tests(), (plus, high), (times, double), (aki, (high & soon) | double)]

    def min_days(self) -> dict[str, int]:
        return {name: days for name, (_, days) in self.drugs.items() if days > 1}

    def all_tasks(self) -> list[str]:
        return [n for n, _ in self.future_tests()] + [n for n, _ in self.neutropenia_names()]


def window_to_events(windows: DataFrame, events: DataFrame, simulations: DataFrame,
                     horizon_days: int = 7, carry: Sequence[str] = (),
                     order: str | None = None) -> DataFrame:
    """Real and simulated events of (eval, eval + horizon] per window.

    `order` names the column of both inputs that holds the order of their rows.

    Adds `sim_id` ("real" for observed rows) and `horizon`, the first horizon
    in days that reaches the event.
    """
    spans = windows.select(*WINDOW, "eval_min", *carry).withColumns({
        "start_min": F.col("eval_min"), "end_min": F.col("eval_min") + horizon_days * DAY})
    columns = ["type", "age_min", "code", "result"] + ([order] if order else [])
    real = events_in_windows(
        events.filter(F.col("type") != fv.DEMOGRAPHICS).select("patient_id", *columns), spans)
    real = real.withColumn("sim_id", F.lit(REAL))
    sims = events_in_windows(
        simulations.filter(F.col("type") != fv.DEMOGRAPHICS).select(*WINDOW, "sim_id", *columns),
        spans, keys=WINDOW)
    horizon = F.ceil((F.col("age_min") - F.col("eval_min")) / DAY).cast("int")
    names = [*WINDOW, "eval_min", *carry, "sim_id", *columns]
    return real.select(*names).unionByName(sims.select(*names)).withColumn("horizon", horizon)


def last_observations(windows: DataFrame, events: DataFrame, rules: TaskRules = TaskRules(),
                      look_back_days: int = 7) -> DataFrame:
    """(window, task, last_obs_min, last_value) from the days before each window.

    `last_obs_min` is the time since the task's last event, `last_value` the
    latest lab value of the task's test; creatinine looks at the same day only.
    """
    spans = windows.select(*WINDOW, "eval_min").withColumns({
        "start_min": F.col("eval_min") - look_back_days * DAY, "end_min": F.col("eval_min")})
    seen = events_in_windows(events.filter(F.col("type") != fv.DEMOGRAPHICS), spans,
                             closed_start=True)
    keys = [*WINDOW, "eval_min"]
    entries = []
    for name, cond in rules._drug_tests():
        entries.append((name, cond, F.lit(None).cast("double")))
    for lab, (code, unit, lows, highs) in rules.labs.items():
        value = c.lab_value("code", "result", code, unit)
        for sign, limits in (("<", lows), (">", highs)):
            for t in limits:
                hit = value < t if sign == "<" else value > t
                entries.append((f"{lab}_{sign}_{t}_{unit}", hit, value))
    same_day = F.col("age_min") >= F.floor(F.col("eval_min") / DAY) * DAY
    cre = F.when(same_day, rules.creatinine_value())
    for name in rules.creatinine_names():
        entries.append((name, F.lit(False), cre))
    found = F.filter(F.array(*[
        F.struct(F.lit(n).alias("task"), F.coalesce(h, F.lit(False)).alias("hit"), v.alias("value"))
        for n, h, v in entries]), lambda s: s["hit"] | s["value"].isNotNull())
    tie = F.col("event_id") if "event_id" in events.columns else F.lit(0)
    rows = seen.select(*keys, "age_min", tie.alias("__tie"), F.explode(found).alias("s")).select(
        *keys, "age_min", "__tie", "s.*")
    anc = neutrophil_counts(seen, keys, rules.neutropenia)
    anc_rows = anc.select(*keys, "age_min", F.lit(0).cast("long").alias("__tie"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("task"), (F.col("anc") < t).alias("hit"), F.col("anc").alias("value"))
        for n, t in rules.neutropenia_names()])).alias("s")).select(*keys, "age_min", "__tie", "s.*")
    every = rows.withColumn("__tie", F.col("__tie").cast("long")).unionByName(anc_rows)
    latest = F.when(F.col("value").isNotNull(), F.struct("age_min", "__tie"))
    return every.groupBy(*keys, "task").agg(
        (F.col("eval_min") - F.max(F.when(F.col("hit"), F.col("age_min")))).alias("last_obs_min"),
        F.max_by("value", latest).alias("last_value"))


def baseline_creatinine(windows: DataFrame, observations: DataFrame, rules: TaskRules = TaskRules()
                        ) -> DataFrame:
    """Windows with `base_cre`, the day's last creatinine before the window."""
    base = observations.filter(F.col("task") == rules.creatinine_names()[2]).select(
        *WINDOW, F.col("last_value").alias("base_cre"))
    return windows.join(base, list(WINDOW), "left")


def task_hits(matched: DataFrame, rules: TaskRules = TaskRules()) -> DataFrame:
    """(window, eval_min, base_cre, sim_id, task, hit_horizon): first horizon of each task.

    A task that asks for several days is hit on the first event of the last
    needed day.
    """
    keys = [*WINDOW, "eval_min", "base_cre", "sim_id"]
    names = F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules.future_tests()]))
    rows = matched.select(*keys, "age_min", F.explode(names).alias("task"))
    anc = neutrophil_counts(matched, keys, rules.neutropenia)
    low = F.array_compact(F.array(*[F.when(F.col("anc") < t, F.lit(n))
                                    for n, t in rules.neutropenia_names()]))
    rows = rows.unionByName(anc.select(*keys, "age_min", F.explode(low).alias("task")))
    days = rows.groupBy(*keys, "task", F.floor(F.col("age_min") / DAY).alias("__d")).agg(
        F.min("age_min").alias("__a"))
    needed = F.coalesce(c.map_literal("task", rules.min_days()), F.lit(1)) if rules.min_days() \
        else F.lit(1)
    # at most one entry per day of the window
    hits = days.groupBy(*keys, "task").agg(F.array_sort(F.collect_list("__a")).alias("__h"))
    age = F.try_element_at("__h", needed)
    return (hits.withColumn("__age", age).filter(F.col("__age").isNotNull())
            .select(*keys, "task",
                    F.ceil((F.col("__age") - F.col("eval_min")) / DAY).cast("int").alias("hit_horizon")))


def _probability_rows(windows: DataFrame, hits: DataFrame, rules: TaskRules, horizon_days: int) -> DataFrame:
    """Observed flag and simulated hit counts per (window, task, horizon), zeros kept."""
    keys = [*WINDOW, "task"]
    spine = windows.select(*WINDOW, "eval_min", "base_cre", "n_sim", F.explode(
        F.array(*[F.lit(t) for t in rules.all_tasks()])).alias("task"))
    spine = spine.filter(F.col("base_cre").isNotNull()
                         | ~F.col("task").isin(*rules.creatinine_names()))
    real = F.col("sim_id") == REAL
    rows = spine.select(*keys, "eval_min", "base_cre", "n_sim",
                        F.lit(None).cast("string").alias("sim_id"),
                        F.lit(None).cast("int").alias("hit_horizon")).unionByName(
        hits.select(*keys, F.lit(None).cast("long").alias("eval_min"),
                    F.lit(None).cast("double").alias("base_cre"),
                    F.lit(None).cast("long").alias("n_sim"), "sim_id", "hit_horizon"))
    per = []
    for h in range(1, horizon_days + 1):
        reached = F.col("hit_horizon") <= h
        per.append(F.struct(
            F.lit(h).alias("horizon"), F.count_if(real & reached).alias("a"),
            F.count_if(~real & reached).alias("s")))
    grouped = rows.groupBy(*keys).agg(
        F.max("eval_min").alias("eval_min"), F.max("base_cre").alias("base_cre"),
        F.max("n_sim").alias("n_sim"), *[p.alias(f"__h{i}") for i, p in enumerate(per)])
    grouped = grouped.filter(F.col("n_sim") > 0)
    long = grouped.withColumn("h", F.explode(F.array(*[F.col(f"__h{i}") for i in range(len(per))])))
    aki = rules.creatinine_names()[2]
    return (long.filter((F.col("task") != aki) | (F.col("h.horizon") == horizon_days))
            .select(*keys, "eval_min", "n_sim", F.col("h.horizon").alias("horizon"),
                    (F.col("h.a") > 0).cast("int").alias("actual"),
                    (F.col("h.s") / F.col("n_sim")).alias("prob")))


def simulation_counts(simulations: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    return simulations.groupBy(*keys).agg(F.count_distinct("sim_id").alias("n_sim"))


def event_probabilities(windows: DataFrame, events: DataFrame, simulations: DataFrame,
                        rules: TaskRules = TaskRules(), horizon_days: int = 7) -> DataFrame:
    """(window, horizon, task, actual, prob, last_obs_min, last_value) of every task.

    Windows without simulations are left out; creatinine tasks need a baseline.
    """
    observed = last_observations(windows, events, rules)
    based = baseline_creatinine(windows, observed, rules)
    matched = window_to_events(based, events, simulations, horizon_days, carry=["base_cre"])
    hits = task_hits(matched, rules)
    counted = based.join(simulation_counts(simulations), list(WINDOW))
    probs = _probability_rows(counted, hits, rules, horizon_days)
    return probs.join(observed.drop("eval_min"), [*WINDOW, "task"], "left")


def hit_bitmaps(hits: DataFrame, lists: DataFrame, horizon_days: int = 7) -> DataFrame:
    """(window, task, actual, bits): the horizon of the observed hit, and for each horizon
    a bitmap over the window's simulations that have hit the task by then."""
    real = F.col("sim_id") == REAL
    # At most one entry for each simulation of the window.
    found = hits.groupBy(*WINDOW, "task").agg(
        F.min(F.when(real, F.col("hit_horizon"))).alias("actual"),
        F.collect_list(F.when(~real, F.struct("sim_id", "hit_horizon"))).alias("found"))
    placed = found.join(lists, list(WINDOW)).withColumn("found", F.transform("found", lambda x: F.struct(
        (F.array_position("sims", x["sim_id"]) - 1).cast("int").alias("at"), x["hit_horizon"].alias("horizon"))))

    def by(h: int) -> Column:
        reached = F.filter("found", lambda x: x["horizon"] <= h)
        return resample.place_bits(F.transform(reached, lambda x: x["at"]), F.size("sims"))
    return placed.select(*WINDOW, "task", "actual", F.array(*[by(h) for h in range(1, horizon_days + 1)]).alias("bits"))


def mc_metric_inputs(windows: DataFrame, events: DataFrame, simulations: DataFrame,
                     masks: DataFrame, rules: TaskRules = TaskRules(), horizon_days: int = 7
                     ) -> DataFrame:
    """(sample_size, repeat, task, horizon, label, prob, n): how many windows have that label and probability.

    `masks` holds the samples as bitmaps (`resample.sample_masks`). A task's probability in a
    sample is the number of bits its hits share with the sample's mask; no sample meets a
    hit. Windows without any hit, most of them, are not listed: the class of label 0 and
    probability 0 is what the others leave of all windows.
    """
    observed = last_observations(windows, events, rules)
    based = baseline_creatinine(windows, observed, rules)
    hits = task_hits(window_to_events(based, events, simulations, horizon_days, ["base_cre"]), rules)
    bits = hit_bitmaps(hits, resample.trajectory_lists(simulations, WINDOW), horizon_days)
    creatinine = rules.creatinine_names()
    class_of = ["sample_size", "repeat", "task", "horizon", "label", "prob"]

    def shared(h: Column) -> Column:
        words = F.zip_with(h, F.col("mask"), lambda b, m: F.bit_count(b.bitwiseAND(m)).cast("long"))
        return F.aggregate(words, F.lit(0).cast("long"), lambda a, n: a + n)
    met = bits.join(masks.drop("sims"), list(WINDOW)).select(
        "sample_size", "repeat", "task", "actual", "n_sim", F.posexplode(F.transform("bits", shared)))
    listed = met.select(
        "sample_size", "repeat", "task", (F.col("pos") + 1).alias("horizon"),
        F.coalesce(F.col("actual") <= F.col("pos") + 1, F.lit(False)).cast("int").alias("label"),
        (F.col("col") / F.col("n_sim")).alias("prob"))
    listed = listed.filter(((F.col("label") > 0) | (F.col("prob") > 0)) & ((F.col("task") != creatinine[2]) | (F.col("horizon") == horizon_days)))
    listed = listed.groupBy(*class_of).agg(F.count(F.lit(1)).alias("n"))
    totals = masks.join(based.select(*WINDOW, "base_cre"), list(WINDOW)).groupBy("sample_size", "repeat").agg(
        F.count(F.lit(1)).alias("all"), F.count("base_cre").alias("with_base"))
    # One row for each sample, task and horizon: parameters of the run, not windows.
    cells = [(t, h) for t in rules.all_tasks() for h in range(1, horizon_days + 1) if t != creatinine[2] or h == horizon_days]
    empty = totals.select("*", F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.lit(h).alias("horizon")) for t, h in cells])).alias("c")).select(
        "sample_size", "repeat", "c.task", "c.horizon", F.lit(0).alias("label"), F.lit(0.0).alias("prob"),
        F.when(F.col("c.task").isin(*creatinine), F.col("with_base")).otherwise(F.col("all")).alias("n"))
    taken = listed.withColumns({"label": F.lit(0), "prob": F.lit(0.0), "n": -F.col("n")})
    return listed.unionByName(empty).unionByName(taken).groupBy(*class_of).agg(F.sum("n").alias("n")).filter("n > 0")


def patient_code_counts(rows: DataFrame, trajectories: DataFrame, keys: Sequence[str],
                        targets: dict[str, Sequence[str]]) -> DataFrame:
    """(keys, kind, code, n): counts per target code, and totals with a null code.

    Every trajectory has a row for every kind and target code, zeros included.
    """
    kind = None
    for name, types in TRAJECTORY_KINDS.items():
        cond = F.col("type").isin(*types)
        kind = F.when(cond, F.lit(name)) if kind is None else kind.when(cond, F.lit(name))
    wanted = [(k, None) for k in TRAJECTORY_KINDS] + [(k, x) for k, v in targets.items() for x in v]
    target = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).cast("string").alias("code"))
                       for k, x in wanted])
    is_target = F.lit(False)
    for k, v in targets.items():
        is_target = is_target | ((F.col("kind") == k) & F.col("code").isin(*v))
    spine = trajectories.select(*keys, F.explode(target).alias("t")).select(
        *keys, "t.*", F.lit(0).alias("__n"))
    typed = rows.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    total = typed.select(*keys, "kind", F.lit(None).cast("string").alias("code"), F.lit(1).alias("__n"))
    single = typed.filter(is_target).select(*keys, "kind", "code", F.lit(1).alias("__n"))
    return (spine.unionByName(total).unionByName(single).groupBy(*keys, "kind", "code")
            .agg(F.sum("__n").alias("n")))


def lab_presence(rows: DataFrame, trajectories: DataFrame, keys: Sequence[str], codes: Sequence[str]
                 ) -> DataFrame:
    """One 0/1 column per lab code and trajectory."""
    seen = rows.filter((F.col("type") == fv.LAB) & F.col("code").isin(*codes)).select(*keys, "code")
    spine = trajectories.select(*keys, F.lit(None).cast("string").alias("code"))
    return seen.unionByName(spine).groupBy(*keys).agg(*[
        F.coalesce(F.max((F.col("code") == x).cast("int")), F.lit(0)).alias(x) for x in codes])


def _all_pairs(found: DataFrame, codes: Sequence[str] | None, by: Sequence[str], same: bool) -> DataFrame:
    """`found` with rows of zero count for the pairs of the listed codes that never meet."""
    if codes is None:
        return found
    spark, listed = found.sparkSession, [(a, b) for i, a in enumerate(codes) for b in codes[i + (not same):]]
    pairs = spark.createDataFrame(listed, "code_1 string, code_2 string")
    if by:
        pairs = found.select(*by).distinct().withColumn("__p", F.explode(F.array(*[
            F.struct(F.lit(a).alias("code_1"), F.lit(b).alias("code_2")) for a, b in listed]))).select(*by, "__p.*")
    return pairs.join(found, [*by, "code_1", "code_2"], "left")


def presence_pairs(present: DataFrame, keys: Sequence[str], codes: Sequence[str] | None = None,
                   by: Sequence[str] = ()) -> DataFrame:
    """(code_1, code_2, n_both): trajectories that hold both codes.

    `present` has (keys, code). With `codes`, pairs in the order of that list and zeros
    for pairs that never meet.
    """
    rows = present.select(*by, *keys, "code").distinct().withColumn("__k", _rank("code", codes)).filter(F.col("__k").isNotNull())
    counted = tiled_pairs(rows, [*by, *keys], ["code"]).filter(F.col("a.__k") < F.col("b.__k")).groupBy(
        *by, F.col("a.code").alias("code_1"), F.col("b.code").alias("code_2")).agg(F.count(F.lit(1)).alias("n_both"))
    return _all_pairs(counted, codes, by, False).withColumn("n_both", F.coalesce("n_both", F.lit(0).cast("long")))


def tiled_pairs(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], tile: int = PAIR_TILE) -> DataFrame:
    """(keys, a, b): the pairs of entries (__k, fields) of each key, a.__k <= b.__k.

    The entries of a key, at most one for each code of the dictionary, are one sparse
    vector. Its tiles of `tile` entries meet pairwise as rows of two short arrays, so a
    key of many codes is never one large product, and sums over the pairs combine where
    the vector lies: what is shuffled is one row for each task and pair of codes.
    """
    vector = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", *fields))).alias("__v"))
    last = (F.ceil(F.size("__v") / tile) - 1).cast("int")
    tiles = vector.withColumn("__i", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "__j", F.explode(F.sequence(F.col("__i"), last)))
    part = lambda at: F.slice("__v", F.col(at) * tile + 1, F.lit(tile))
    short = tiles.select(*keys, part("__i").alias("__a"), part("__j").alias("__b"))
    pairs = short.select(*keys, F.explode("__a").alias("a"), "__b").select(*keys, "a", F.explode("__b").alias("b"))
    return pairs.filter(F.col("a.__k") <= F.col("b.__k"))


def _rank(code: str, codes: Sequence[str] | None) -> Column:
    """Place of a code in the list, or the code itself."""
    if codes is None:
        return F.col(code)
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in codes]), F.col(code)), F.lit(0))


def lab_values(rows: DataFrame, keys: Sequence[str] = ("patient_id",), order: str = "event_id",
               codes: Sequence[str] | None = None) -> DataFrame:
    """(keys, age_min, code, value): numeric results, the first of a code at one time (ties: the smaller)."""
    wanted = rows if codes is None else rows.filter(F.col("code").isin(*codes))
    parsed = wanted.withColumn("value", c.leading_number("result")).filter(F.col("value").isNotNull())
    return parsed.groupBy(*keys, "age_min", "code").agg(F.min_by("value", F.struct(F.col(order), "value")).alias("value"))


def lab_pivot(rows: DataFrame, codes: Sequence[str], keys: Sequence[str] = ("patient_id",),
              order: str = "event_id", fill: DataFrame | None = None) -> DataFrame:
    """(keys, age) by code table of numeric results; the first value of a cell wins.

    With `fill`, trajectories without values get one empty row.
    """
    wide = lab_values(rows, keys, order, codes).groupBy(*keys, "age_min").pivot("code", list(codes)).agg(F.first("value"))
    if fill is not None:
        empty = fill.select(*keys).distinct().join(wide.select(*keys), list(keys), "left_anti")
        wide = wide.unionByName(empty, allowMissingColumns=True)
    return wide


def correlation_matrix(values: DataFrame, keys: Sequence[str] = ("patient_id",), codes: Sequence[str] | None = None,
                       min_pairs: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """(code_1, code_2, n, r): Pearson over times with both codes, null below `min_pairs`.

    `values` has (keys, age_min, code, value), one value per cell. With `codes`, pairs
    in the order of that list and empty rows for pairs that never meet.
    """
    rows = values.select(*by, *keys, "age_min", "code", "value").withColumn("__k", _rank("code", codes)).filter(
        F.col("__k").isNotNull())
    found = tiled_pairs(rows, [*by, *keys, "age_min"], ["code", "value"]).groupBy(
        *by, F.col("a.code").alias("code_1"), F.col("b.code").alias("code_2")).agg(
        F.count(F.lit(1)).alias("n"), F.corr("a.value", "b.value").alias("__r"))
    long = _all_pairs(found, codes, by, True)
    r = F.when((F.col("n") >= min_pairs) & ~F.isnan("__r"), F.col("__r"))
    return long.withColumn("r", r).withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).drop("__r")


def lab_distribution(matched: DataFrame, trajectories: DataFrame, codes: Sequence[str],
                     horizon_days: int = 7, order: str = "event_id") -> DataFrame:
    """Lab pivots per (source, horizon) of real and simulated windows.

    Of several values of a code at one time the first by `order` counts. A
    simulation without values has an empty row; a real window has one if any of
    its events lies within the horizon. An age of a window has one horizon, so values are
    picked and pivoted before the rows are spread over the horizons.
    """
    keys = [*WINDOW, "sim_id", "reach"]
    onward = F.explode(F.sequence("horizon", F.lit(horizon_days)))
    rows = matched.filter(F.col("type") == fv.LAB)
    wide = lab_pivot(rows, codes, [*WINDOW, "sim_id", "horizon"], order).withColumn("reach", onward).select(
        *keys, "age_min", *[F.col(f"`{x}`") for x in codes])
    simulated = trajectories.filter(F.col("sim_id") != REAL).select(*WINDOW, "sim_id").withColumn(
        "reach", F.explode(F.sequence(F.lit(1), F.lit(horizon_days))))
    seen = (matched.filter(F.col("sim_id") == REAL).groupBy(*WINDOW, "sim_id").agg(F.min("horizon").alias("horizon"))
            .withColumn("reach", onward).drop("horizon"))
    valued = (rows.filter(F.col("code").isin(*codes) & c.leading_number("result").isNotNull())
              .groupBy(*WINDOW, "sim_id").agg(F.min("horizon").alias("horizon")).withColumn("reach", onward).select(*keys))
    empty = simulated.unionByName(seen).distinct().join(valued, keys, "left_anti")
    wide = wide.unionByName(empty, allowMissingColumns=True)
    source = F.when(F.col("sim_id") == REAL, F.lit("real")).otherwise(F.lit("simulation"))
    return wide.withColumn("source", source)


def token_lengths(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_tokens): distinct ages plus filled codes and results, demographics excluded."""
    return (rows.filter(F.col("type") != fv.DEMOGRAPHICS).groupBy(*keys, "age_min")
            .agg(F.count_if(F.nullif("code", F.lit("")).isNotNull()).alias("c"),
                 F.count_if(F.nullif("result", F.lit("")).isNotNull()).alias("r"))
            .groupBy(*keys).agg((F.count(F.lit(1)) + F.sum("c") + F.sum("r")).alias("n_tokens")))


def horizon_lengths(matched: DataFrame, trajectories: DataFrame, horizon_days: int = 7) -> DataFrame:
    """(window, sim_id, horizon, n_tokens) for every trajectory and horizon."""
    keys = [*WINDOW, "sim_id"]
    per_age = matched.groupBy(*keys, "age_min", "horizon").agg(
        (F.lit(1) + F.count_if(F.nullif("code", F.lit("")).isNotNull())
         + F.count_if(F.nullif("result", F.lit("")).isNotNull())).alias("__n"))
    spine = trajectories.select(*keys, F.lit(None).cast("int").alias("horizon"),
                                F.lit(0).cast("long").alias("__n"))
    sums = [F.coalesce(F.sum(F.when(F.col("horizon") <= h, F.col("__n"))), F.lit(0)).alias(f"__{h}")
            for h in range(1, horizon_days + 1)]
    wide = per_age.select(*keys, "horizon", "__n").unionByName(spine).groupBy(*keys).agg(*sums)
    return wide.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"__{h}").alias("n_tokens"))
        for h in range(1, horizon_days + 1)])).alias("h")).select(*keys, "h.*")


def length_calibration(lengths: DataFrame, levels: int = 21) -> DataFrame:
    """(window, horizon, level, low, high, n_tokens, within).

    Level k is the central k % interval of the simulated lengths of a window,
    whose number is a run parameter; the 0 % interval is empty.
    """
    keys = [*WINDOW, "horizon"]
    steps = levels - 1
    low_q = [0.5 - 0.5 * i / steps for i in range(levels)]
    high_q = [0.5 + 0.5 * i / steps for i in range(levels)]
    is_real = F.col("sim_id") == REAL
    both = lengths.groupBy(*keys).agg(
        F.percentile(F.when(~is_real, F.col("n_tokens")),
                     F.array(*[F.lit(x) for x in low_q + high_q])).alias("__q"),
        F.max(F.when(is_real, F.col("n_tokens"))).alias("n_tokens"))
    both = both.filter(F.col("n_tokens").isNotNull() & F.col("__q").isNotNull())
    out = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    low = F.element_at("__q", F.col("i") + 1)
    high = F.element_at("__q", F.col("i") + 1 + levels) - F.when(
        F.col("i") == 0, F.lit(0.01)).otherwise(F.lit(0.0))
    return out.select(
        *keys, (F.col("i") * 100 / F.lit(steps)).cast("int").alias("level"), low.alias("low"),
        high.alias("high"), "n_tokens",
        ((low <= F.col("n_tokens")) & (F.col("n_tokens") <= high)).cast("int").alias("within"))


def calibration_coverage(calibration: DataFrame) -> DataFrame:
    return calibration.groupBy("horizon", "level").agg(
        F.avg("within").alias("coverage"), F.count(F.lit(1)).alias("n_windows"))


def trajectory_list(windows: DataFrame, simulations: DataFrame) -> DataFrame:
    """(window, sim_id) of all simulations and the real trajectory of each window."""
    sims = simulations.select(*WINDOW, "sim_id").distinct()
    real = windows.select(*WINDOW, F.lit(REAL).alias("sim_id"))
    return sims.unionByName(real)
