"""Samples and hits of simulations as bitmaps, against counting."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from chronoline.operators import resample, simeval

WINDOW = list(simeval.WINDOW)
RULES = simeval.TaskRules(drugs={"x": (("X",), 1)}, labs={}, creatinine={"code": "CRE", "unit": "u", "plus": 0.3, "times": 1.5},
                          neutropenia={"wbc_code": "W", "wbc_unit": "u", "wbc_const": 1000, "neutrophil_codes": ("N",),
                                       "neutrophil_unit": "u", "thresholds": (1000,)})


def test_bits(spark):
    got = spark.createDataFrame([([0, 63, 64, 129], 130), ([], 5), ([1], 1 + 1)], "p array<int>, n int").select(
        resample.place_bits(F.col("p"), F.col("n")).alias("b")).collect()
    bits = [{64 * w + k for w, x in enumerate(r.b) for k in range(64) if (x & (2 ** 64 - 1)) >> k & 1} for r in got]
    assert bits == [{0, 63, 64, 129}, set(), {1}] and len(got[0].b) == 3


def windows_and_simulations(spark, sims=130):
    windows = spark.createDataFrame([(f"p{w}", 0, 1, 10_000) for w in range(5)], "patient_id string, admission_no int, day int, eval_min long")
    rows = []
    for w in range(4):   # the last window has no simulations
        for s in range(sims if w else 3):
            rows.append((f"p{w}", 0, 1, f"s{s}", 4, 10_000 + 1 + 1440 * ((s * 7 + w) % 9), "X1" if (s * 5 + w) % 3 else "Q", ""))
    schema = "patient_id string, admission_no int, day int, sim_id string, type int, age_min long, code string, result string"
    events = [("p1", 4, 12_000, "X2", ""), ("p2", 4, 19_000, "X9", ""), ("p3", 4, 30_000, "X9", ""), ("p0", 6, 9_999, "CRE", "1.0 u")]
    return windows, spark.createDataFrame(events, "patient_id string, type int, age_min long, code string, result string"), spark.createDataFrame(rows, schema)


def test_masks_are_the_samples(spark):
    _, _, sims = windows_and_simulations(spark)
    rows = resample.subsample_trajectories(sims, WINDOW, [2, 70, 500], 3).collect()
    listed = defaultdict(set)
    for r in rows:
        listed[r.patient_id, r.sample_size, r.repeat].add(r.sim_id)
    masks = resample.sample_masks(sims, WINDOW, [2, 70, 500], 3).collect()
    assert len(masks) == 4 * 9
    for r in masks:
        held = {r.sims[64 * w + k] for w, x in enumerate(r.mask) for k in range(64) if (x & (2 ** 64 - 1)) >> k & 1}
        assert held == listed[r.patient_id, r.sample_size, r.repeat] and r.n_sim == len(held) == min(r.sample_size, len(r.sims))


def test_metric_inputs_against_counting(spark):
    windows, events, sims = windows_and_simulations(spark)
    masks = resample.sample_masks(sims, WINDOW, [2, 70, 500], 3)
    out = simeval.mc_metric_inputs(windows, events, sims, masks, RULES)
    got = {(r.sample_size, r.repeat, r.horizon, r.label, round(r.prob, 9)): r.n for r in out.filter("task = 'x'").collect()}
    samples = defaultdict(set)
    for r in resample.subsample_trajectories(sims, WINDOW, [2, 70, 500], 3).collect():
        samples[r.patient_id, r.sample_size, r.repeat].add(r.sim_id)
    hits = defaultdict(dict)
    for r in sims.collect():
        day = -(-(r.age_min - 10_000) // 1440)
        if r.code.startswith("X") and 0 < day <= 7:
            hits[r.patient_id][r.sim_id] = day
    real = {"p1": -(-2000 // 1440), "p2": -(-9000 // 1440)}
    want = Counter()
    for (p, size, repeat), drawn in samples.items():
        for h in range(1, 8):
            n = sum(hits[p].get(s, 99) <= h for s in drawn)
            want[size, repeat, h, int(real.get(p, 99) <= h), round(n / len(drawn), 9)] += 1
    assert got == dict(want)
    # Creatinine tasks count the one window with a baseline, the combined one at the last horizon only.
    names = RULES.creatinine_names()
    assert {(r.task, r.horizon, r.n) for r in out.filter(F.col("task") == names[2]).collect()} == {(names[2], 7, 1)}
    assert out.filter(F.col("task") == names[0]).agg(F.sum("n")).first()[0] == 9 * 7


def test_no_simulations(spark):
    windows, events, sims = windows_and_simulations(spark)
    none = sims.filter("false")
    assert simeval.mc_metric_inputs(windows, events, none, resample.sample_masks(none, WINDOW, [2], 2), RULES).count() == 0
