import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoline import fixed_values as fv
from chronoline.functions import scalars as c
from chronoline.operators import (audit, clean, cohort, labstats, lookups, matrix, metrics, resample,
                                  simeval, stays, timeline, vocab)

EVENTS = "patient_id string, event_id long, type int, age_min long, code string, result string"


def events(spark, codes, patient="p"):
    kind = {"[ADM]": 1, "[DSC]": 2, "[M]": 0}
    data = [(patient, i, kind.get(x, 3), i * 20_000, x, "") for i, x in enumerate(codes)]
    return spark.createDataFrame(data, EVENTS)


@pytest.mark.parametrize("codes,either,both", [
    (["[ADM]", "x", "[DSC]", "y"], [1, 1, 0, 0], [0, 1, 0, 0]),
    (["[ADM]", "[DSC]"], [1, 0], [0, 0]),
    (["[ADM]", "x"], [1, 1], [0, 0]),
    (["x", "[DSC]"], [1, 0], [0, 0]),
])
def test_flag_admitted(spark, codes, either, both):
    frame = events(spark, codes)
    get = lambda d: [r["admitted"] for r in d.orderBy("event_id").collect()]
    assert get(stays.flag_admitted(frame)) == either
    assert get(stays.flag_admitted(frame, ignore_truncated=True)) == both


def test_stay_pairs_and_days(spark):
    frame = events(spark, ["[ADM]", "[ADM]", "x", "[DSC]", "[DSC]", "[ADM]"])
    pairs = stays.complete_admissions(frame, period=None).collect()
    assert [(r["adm_min"], r["dsc_min"], r["admission_no"]) for r in pairs] == [(20_000, 60_000, 0)]
    nearest = {r["adm_min"]: r["dsc_min"] for r in lookups.pair_admissions(frame).collect()}
    assert nearest == {0: 60_000, 20_000: 60_000}
    days = stays.admission_day_snapshots(stays.complete_admissions(frame, period=None)).collect()
    assert all(r["adm_min"] <= r["eval_min"] <= r["dsc_min"] for r in days) and len(days) == 28


def test_baseline_start_without_hour_lies_after_the_admission(spark):
    frame = events(spark, ["[ADM]", "x", "x", "[DSC]"])
    days = stays.inpatient_day_table(frame, min_days=1).select("patient_id", "hospital_day")
    got = stays.baseline_distribution(frame, days, [F.count("event_id").alias("n")], hour=None)
    rows = got.collect()
    assert len(rows) == 7 * days.count()
    assert all(0 <= r["start_min"] <= 1440 for r in rows)


@pytest.mark.parametrize("counts,tokens", [
    ({"A": 5, "O": 3}, {"A": "[top1]", "O": "[top2]"}),
    ({"(+)": 5, "(-)": 2}, {"(+)": "[pos]", "(-)": "[neg]"}),
    ({"(+)": 5, "X": 3}, {"(+)": "[top1]", "X": "[top2]"}),
])
def test_rank_nonnumeric_tokens(rows, counts, tokens):
    frame = rows([("c", k, n) for k, n in counts.items()], "item_code string, nonnumeric string, count long")
    got = {r["nonnumeric"]: r["token"] for r in labstats.rank_nonnumeric_tokens(frame).collect()}
    assert got == tokens


@pytest.mark.parametrize("n", [1, 2, 4, 6, 57])
def test_percentile_grid_takes_the_nearest_rank(rows, n):
    values = [float(10 * (i + 1)) for i in range(n)]
    counts = labstats.numeric_value_counts(rows(
        [("c", None, x) for x in values], "item_code string, unit string, numeric double"))
    grid = labstats.percentile_grid(counts, bins=51).first()["grid"]
    low = np.log(1e-7 / (1 - 1e-7))
    steps = 1 / (1 + np.exp(-np.linspace(low, -low, 51)))
    assert grid == list(np.percentile(values, steps * 100, method="nearest"))


def test_nearest_bins_equal_brute_force(rows):
    rng = np.random.default_rng(0)
    grid = np.sort(rng.normal(size=101).round(1))
    values = [float(x) for x in rng.normal(size=200).round(2)] + [-99.0, 99.0]
    labs = rows([("c", "u", x) for x in values] + [("c", "other", 1.0), ("c", "u", None)],
                "item_code string, unit string, numeric double")
    grids = rows([("c", "u", [float(g) for g in grid])], "item_code string, unit string, grid array<double>")
    got = labstats.nearest_bins(labs, grids).collect()
    for r in got:
        if r["unit"] == "other" or r["numeric"] is None:
            assert r["bin"] is None
        else:
            assert r["bin"] == int(np.argmin(np.abs(grid - r["numeric"])))


def test_nearest_bins_of_a_frequent_code(spark, rows):
    """Grids across zero, of tiny and of equal values; one code holds nearly all rows and spreads over many pieces."""
    rng = np.random.default_rng(4)
    grid = {"hot": np.sort(np.round(rng.normal(size=501) * 50, 2)), "tiny": np.arange(1, 22) * 1e-9, "flat": np.full(21, 3.5),
            "low": -np.sort(rng.lognormal(size=51))[::-1]}
    values = [("hot", float(x)) for x in rng.normal(size=3000) * 60] + [("hot", float(x)) for x in grid["hot"][::7]]
    values += [("tiny", 4.5e-9), ("tiny", 4.4e-9), ("flat", 3.5), ("flat", -1.0), ("low", -0.9), ("low", 5.0), ("low", -1e9), ("none", 1.0)]
    labs = rows([(c, None, x, "kept") for c, x in values], "item_code string, unit string, numeric double, lower string").drop("lower")
    grids = rows([(c, "", [float(x) for x in g]) for c, g in grid.items()], "item_code string, unit string, grid array<double>")
    got = labstats.nearest_bins(labs, grids)
    for r in got.collect():
        if r["item_code"] == "none":
            assert r["bin"] is None
        else:
            assert r["bin"] == int(np.argmin(np.abs(grid[r["item_code"]] - r["numeric"])))
    assert got.count() == len(values) and got.columns == ["item_code", "unit", "numeric", "bin"]
    spread = labstats.grid_intervals(grids).filter("item_code = 'hot'").groupBy("seg").count()
    assert spread.count() > 300 and spread.agg(F.max("count")).first()[0] < 40


def test_numeric_stats_match_numpy(rows):
    rng = np.random.default_rng(2)
    x = rng.lognormal(size=400).round(3)
    frame = rows([("c", "u", float(v)) for v in x], "item_code string, unit string, numeric double")
    got = labstats.numeric_stats(labstats.numeric_value_counts(frame), trim_percent=2.0, trim_min_count=100).first()
    lo, hi = np.percentile(x, [2, 98])
    y = np.clip(x, lo, hi)
    want = {"mean": y.mean(), "med": np.median(y), "std": y.std(), "mad": np.median(np.abs(y - np.median(y))),
            "iqr": np.subtract(*np.percentile(y, [75, 25])), "min": x.min(), "max": x.max(),
            "lower_limit": lo, "upper_limit": hi}
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_temporal_split_sizes(rows):
    day = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(days=i)
    spans = rows([(f"p{i}", day(i % 300), day(600 + i % 100)) for i in range(1000)],
                 "patient_id string, first_visit_date timestamp_ntz, last_visit_date timestamp_ntz")
    got = cohort.temporal_split(spans, ("2020-01-01", "2021-01-31"), ("2021-02-01", "2023-01-01"))
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert sizes == {"test": 99, "train": 800, "validation": 101}


def test_bootstrap_weights(rows):
    ids = rows([(f"p{i}",) for i in range(50)], "patient_id string")
    w = resample.bootstrap_weights(ids, 4)
    assert {r["n"] for r in w.groupBy("replicate").agg(F.sum("weight").alias("n")).collect()} == {50}
    again = resample.bootstrap_weights(ids.repartition(7), 4)
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, again.collect()))


def test_subsample_is_exact_and_stable(rows):
    ids = rows([("p", 0, 0, f"s{i}") for i in range(20)], "patient_id string, admission_no int, day int, sim_id string")
    got = resample.subsample_trajectories(ids, ["patient_id", "admission_no", "day"], [3, 8], 5)
    sizes = got.groupBy("sample_size", "repeat").agg(F.count_distinct("sim_id").alias("n")).collect()
    assert len(sizes) == 10 and all(r["n"] == r["sample_size"] for r in sizes)
    again = resample.subsample_trajectories(ids.repartition(5), ["patient_id", "admission_no", "day"], [3, 8], 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_too_many_samples_is_an_error(rows):
    frame = rows([(i,) for i in range(5)], "k long")
    assert resample.draw_samples(frame, 3, ["k"]).count() == 3
    with pytest.raises(Exception, match="asked for 9 samples"):
        resample.draw_samples(frame, 9, ["k"]).collect()


def test_cumulative_coverage(rows):
    frame = rows([("a", 50), ("b", 30), ("c", 15), ("d", 5)], "code string, n long")
    got = labstats.cumulative_coverage(frame, "code", "n", 0.8)
    assert sorted(r["code"] for r in got.collect()) == ["a", "b"]


def test_sequence_and_order_of_a_small_timeline(spark, rows):
    """Time row, code row and result row; demographics first; end row last."""
    stats = rows([("L1", "(+)", 3, "[pos]"), ("L1", "(-)", 2, "[neg]")],
                 "item_code string, nonnumeric string, count long, token string")
    specials = vocab.special_tokens(stats)
    names = {r["token"]: r["index"] for r in specials.collect()}
    assert names["[PAD]"] == 0 and names["[DSC_EXP]"] == 9 and names["[pos]"] == 17
    codes = rows([("dx", "C50"), ("dx", "C50(prov.)"), ("lab", "L1")], "system string, code string")
    tokens, code_map = vocab.vocabulary(codes, specials, {"dx": [1, 2]})
    found = {r["original_value"]: (r["tokens"], r["tokenized_value"]) for r in code_map.collect()}
    first = len(names)
    assert found["C50"] == ([1, first, first + 1, 0], "[DX],C,*50")
    assert found["C50(prov.)"] == ([1, first, first + 1, 6], "[DX],C,*50,[PRV]")
    assert found["L1"] == ([3, first + 2, 0, 0], "[LAB],L1")
    assert tokens.count() == 3

    people = rows([("p", "M", dt.date(1950, 1, 1), "PT1")],
                  "patient_id string, sex string, date_of_birth date, unique_record_id string")
    ts = dt.datetime(2000, 1, 1, 10, 30)
    age = int((ts - dt.datetime(1950, 1, 1)).total_seconds() // 60)
    base = "patient_id string, ts timestamp_ntz, age_min long, time_available_min long, unique_record_id string"
    dx = rows([("p", ts, age, 0, "D1", "C50", 1), ("p", ts, age, 0, "D2", "C50", 1), ("p", ts, age, 0, "D3", "X99", 0)],
              base + ", item_code string, provisional int")
    labs = rows([("p", ts, age, 0, "L1", "L1", None, None, "(+)"), ("p", ts, age, 0, "L2", "L1", None, None, "odd")],
                base + ", item_code string, numeric double, unit string, nonnumeric string")
    grids = rows([("L9", "u", 1, [1.0] * 5)], "item_code string, unit string, count long, grid array<double>")
    seq = timeline.union_tables(
        timeline.sequence_demographics(people, specials, 4),
        timeline.sequence_codes(dx, code_map, "dx", fv.DIAGNOSIS, 4),
        timeline.sequence_labs(labs, grids, stats, code_map, specials, 4, 5))
    exploded = timeline.explode_rows(seq, 4)
    assert {r["original_value"] for r in timeline.oov_report(exploded).collect()} == {"X99"}
    line = timeline.build_timeline(timeline.drop_oov(exploded), {"train_period": ("1999-01-01", "2001-01-01")}, 7, 4)
    shown = [(r["row_no"], r["type"], r["original_value"], r["age_min"]) for r in line.orderBy("row_no").collect()]
    day = age // 1440 * 1440
    assert shown == [
        (0, 0, None, day), (1, 0, "[M]", day), (2, 3, None, age), (3, 3, "C50(prov.)", age),
        (4, 6, None, age), (5, 6, "L1", age), (6, 6, "(+)", age), (7, 7, "[EOT]", age)]


def test_decode_is_the_inverse_of_the_event_view(rows):
    cat = rows([(0, "special", "sex", "[M]", "male"), (1, "dx", "dx", "C50", "x"), (2, "lab", "lab", "L1", "y"),
                (3, "numeric", "numeric", "0.5", ""), (4, "special", "operational", "[EOT]", "")],
               "label int, kind string, family string, original_value string, text string")
    grids = rows([("L1", "mg", 9, [1.0, 2.0, 3.0])], "item_code string, unit string, count long, grid array<double>")
    seq = rows([("p", 0, 5, None), ("p", 1, 5, 0), ("p", 2, 70, None), ("p", 3, None, 1), ("p", 4, None, 2), ("p", 5, None, 3)],
               "patient_id string, row_no int, age_min long, label int")
    got = matrix.decode_timeline(seq, cat, grids, bins=3).orderBy("row_no").collect()
    assert [(r["type"], r["age_min"], r["code"], r["result"]) for r in got] == [
        (0, 5, "[M]", ""), (3, 70, "C50", ""), (6, 70, "L1", "2.0 mg")]


def test_time_shuffle_keeps_the_rules(spark):
    kinds = ["time", "other", "time", "lab", "other", "other", "dsc", "disposition", "other", "time", "other", "eot"]
    data = [("p", i, 100 * sum(k == "time" for k in kinds[: i + 1]), k) for i, k in enumerate(kinds)]
    frame = spark.createDataFrame(data, "patient_id string, row_no int, age_min long, kind string")
    for r in range(3):
        rows_ = matrix.time_shuffle(frame, replicates=3, seed=4).filter(F.col("replicate") == r).collect()
        place = {x["row_no"]: x["new_row_no"] for x in rows_}
        assert sorted(place.values()) == list(range(12))
        assert all(place[i] == i for i in (0, 1, 2, 9, 11))
        assert place[4] == place[3] + 1 and place[7] == place[6] + 1


def brute_auc(y, t, thresholds):
    pos, neg = t == 1, t == 0
    tpr = [(y[pos] >= h).sum() / (pos.sum() + 1e-8) for h in thresholds][::-1]
    fpr = [(y[neg] >= h).sum() / (neg.sum() + 1e-8) for h in thresholds][::-1]
    return sum((fpr[i] - fpr[i - 1]) * (tpr[i] + tpr[i - 1]) / 2 for i in range(1, len(tpr)))


def test_metrics_match_restatement(spark):
    rng = np.random.default_rng(7)
    y = rng.random(300).round(3)
    t = (rng.random(300) < y).astype(int)
    frame = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, y)], "label int, prob double")
    counts = metrics.probability_counts(frame)
    confusion = metrics.confusion_by_threshold(counts)
    thresholds = np.linspace(y.min() - 1e-8, y.max() + 1e-8, 100)
    assert metrics.auroc(confusion).first()["auroc"] == pytest.approx(brute_auc(y, t, thresholds), abs=1e-9)
    tps = [r["tp"] for r in confusion.orderBy("k").collect()]
    assert tps == [int(((y >= h) & (t == 1)).sum()) for h in thresholds]
    fit = metrics.logistic_recalibration(counts, steps=12).first()
    x = np.log(np.clip(y, 1e-10, 1 - 1e-10) / (1 - np.clip(y, 1e-10, 1 - 1e-10)))
    p = 1 / (1 + np.exp(-(fit["intercept"] + fit["slope"] * x)))
    assert abs((t - p).sum()) < 1e-4 and abs(((t - p) * x).sum()) < 1e-3
    bins = metrics.calibration_bins(counts).orderBy("bin").collect()
    assert sum(r["n"] for r in bins) == 300 and len(bins) == 10


def test_event_probabilities_by_hand(spark):
    rules = simeval.TaskRules(drugs={"d": (("J01",), 1), "dd": (("J01",), 2)}, labs={})
    windows = spark.createDataFrame([("p", 0, 0, 10_000)], "patient_id string, admission_no int, day int, eval_min long")
    ev = spark.createDataFrame([
        ("p", 0, 0, 8_640, "[M]", ""), ("p", 1, 4, 10_500, "J01A", ""), ("p", 2, 2, 13_000, "[DSC]", "[DSC_ALV]"),
        ("p", 3, 6, 9_900, "3C0150000023---01", "1.0 mg/dL"), ("p", 4, 6, 12_000, "3C0150000023---01", "1.31 mg/dL")], EVENTS)
    sims = spark.createDataFrame(
        [("p", 0, 0, s, 9, 0, 8_640, "[M]", "") for s in ("s1", "s2")]
        + [("p", 0, 0, "s1", 10, 4, 10_100, "J01A", ""), ("p", 0, 0, "s1", 11, 5, 13_000, "J01B", ""),
           ("p", 0, 0, "s2", 12, 3, 10_100, "J01A", ""), ("p", 0, 0, "s2", 13, 6, 11_000, "3C0150000023---01", "1.6 mg/dL")],
        "patient_id string, admission_no int, day int, sim_id string, event_id long, type int, age_min long, code string, result string")
    got = {(r["task"], r["horizon"]): (r["actual"], r["prob"])
           for r in simeval.event_probabilities(windows, ev, sims, rules).collect()}
    plus, times, aki = rules.creatinine_names()
    assert got[("discharge", 2)] == (0, 0.0) and got[("discharge", 3)] == (1, 0.0)
    assert got[("d", 1)] == (1, 0.5) and got[("dd", 2)] == (0, 0.0) and got[("dd", 3)] == (0, 0.5)
    assert got[(plus, 1)] == (0, 0.5) and got[(plus, 2)] == (1, 0.5)
    assert got[(times, 7)] == (0, 0.5) and got[(aki, 7)] == (1, 0.5)
    assert {h for t, h in got if t == aki} == {7}


def test_sex_plausibility(spark):
    data = [("m", 0, 0, 0, "[M]", ""), ("m", 1, 3, 10, "O80", ""), ("m", 2, 3, 11, "n40.1", ""), ("f", 3, 0, 0, "[F]", ""),
            ("f", 4, 3, 5, "N40", ""), ("f", 5, 4, 6, "G02AB01", ""), ("u", 6, 0, 0, "[U]", ""), ("u", 7, 3, 5, "O80", "")]
    got = {r["patient_id"]: r for r in audit.sex_plausibility(spark.createDataFrame(data, EVENTS), ["patient_id"]).collect()}
    assert got["m"]["n_female_specific_icd_in_male_events"] == 1 and got["m"]["n_diagnosis_events"] == 2
    assert got["f"]["has_male_specific_icd_in_female"] == 1 and got["f"]["n_drug_events"] == 1
    assert got["u"]["n_diagnosis_events"] == 0 and got["u"]["has_any_sex_incompatible"] == 0


def test_window_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    ev = [("hot" if i % 3 == 0 else f"p{i % 5}", i, int(rng.integers(0, 60_000))) for i in range(200)]
    win = [("hot" if i % 3 == 0 else f"p{i % 5}", i, int(s), int(s + rng.integers(0, 30_000)))
           for i, s in enumerate(rng.integers(0, 60_000, size=40))]
    got = clean.events_in_windows(
        spark.createDataFrame(ev, "patient_id string, event_id long, age_min long"),
        spark.createDataFrame(win, "patient_id string, w long, start_min long, end_min long"), bucket=5_000)
    want = {(w, e) for p, w, a, b in win for q_, e, t in ev if p == q_ and a < t <= b}
    pairs = [(r["w"], r["event_id"]) for r in got.collect()]
    assert len(pairs) == len(want) and set(pairs) == want


def test_length_calibration(spark):
    data = [("p", 0, 0, f"s{i}", 1, n) for i, n in enumerate([1, 2, 3, 4, 5])] + [("p", 0, 0, "real", 1, 3)]
    frame = spark.createDataFrame(data, "patient_id string, admission_no int, day int, sim_id string, horizon int, n_tokens long")
    got = {r["level"]: r for r in simeval.length_calibration(frame).collect()}
    assert len(got) == 21 and got[0]["within"] == 0 and got[5]["within"] == 1
    assert (got[100]["low"], got[100]["high"]) == (1.0, 5.0)


def test_truncate_history(rows):
    frame = rows([("p", i) for i in range(10)], "patient_id string, row_no int")
    kept = matrix.truncate_history(frame, ["patient_id"], 5)
    assert sorted(r["row_no"] for r in kept.collect()) == [0, 1, 7, 8, 9]


def test_digest_uniform_range(spark):
    got = spark.range(1000).select(c.digest_uniform(c.stable_digest(0, "id")).alias("u")).agg(
        F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= got[0] < 0.01 and 0.99 < got[1] < 1 and abs(got[2] - 0.5) < 0.05


@pytest.mark.parametrize("noise,ages,labels", [(30, [1440000, 1440000, 1440040, 1440070], [-1, 7, 501, 503]),
                                               (-56, [1440000, 1440000, 1440000, 1440000], [-1, 7, 500, 500]),
                                               (-15, [1440000, 1440000, 1440000, 1440025], [-1, 7, 500, 502])])
def test_noise_moves_both_ends_of_a_step(rows, monkeypatch, noise, ages, labels):
    from chronoline.operators import matrix
    monkeypatch.setattr(matrix.c, "digest_uniform", lambda d: F.lit((noise + 60.5) / 121))
    line = rows([("p", 0, 1440000, 0, 2, -1), ("p", 1, 1440000, 0, None, 7), ("p", 2, 1440010, 3, 2, 501), ("p", 3, 1440040, 3, 2, 503)],
                "patient_id string, row_no int, age_min long, type int, years int, label int")
    got = matrix.time_noise(line, 1, 500).orderBy("row_no").collect()
    assert [r["age_min"] for r in got] == ages and [r["label"] for r in got] == labels
    assert {r["noise_min"] for r in got} == {noise}


def test_epoch_draws_follow_the_weights(rows):
    from chronoline.operators import resample
    lengths = rows([("a", 10), ("b", 96), ("c", 64 * 30)], "patient_id string, effective_length long")
    got = resample.epoch_resample(lengths, 64, 0).collect()  # weights 1, 1.5 and 10
    assert sorted(r["draw"] for r in got) == list(range(1, 14)) and {r["patient_id"] for r in got} <= {"a", "b", "c"}
    assert resample.epoch_resample(lengths.filter("patient_id = 'x'"), 64, 0).count() == 0


def test_epoch_draws_come_from_a_range(rows):
    from chronoline.operators import resample
    lengths = rows([("a", 10), ("b", 96), ("c", 64 * 30)], "patient_id string, effective_length long")
    plan = resample.epoch_resample(lengths, 64, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (1, 14" in plan and "explode(" not in plan


def test_first_lab_value_is_by_row_order(rows):
    from chronoline.operators import simeval
    names = "patient_id string, admission_no int, day int, sim_id string, horizon int, type int, age_min long, code string, result string, event_id long"
    matched = rows([("p", 1, 0, "real", 1, 6, 60, "L", "20 mmol/L", 1), ("p", 1, 0, "real", 1, 6, 60, "L", "100 mmol/L", 2),
                    ("p", 1, 1, "real", 2, 3, 70, "D", "", 3), ("p", 1, 0, "s1", 2, 6, 80, "L", "7 mmol/L", 4)], names)
    all_of = rows([("p", 1, d, s) for d in (0, 1, 2) for s in ("real", "s1")], "patient_id string, admission_no int, day int, sim_id string")
    got = simeval.lab_distribution(matched, all_of, ["L"], 2).collect()
    assert sorted((r["day"], r["sim_id"], r["reach"], r["L"]) for r in got if r["L"] is not None) == [
        (0, "real", 1, 20.0), (0, "real", 2, 20.0), (0, "s1", 2, 7.0)]
    # Simulations always have a row; real windows only with events within the horizon.
    assert sorted((r["day"], r["sim_id"], r["reach"]) for r in got if r["L"] is None) == [
        (0, "s1", 1), (1, "real", 2), (1, "s1", 1), (1, "s1", 2), (2, "s1", 1), (2, "s1", 2)]


def test_repeated_time_rows_go(rows):
    from chronoline.operators import timeline
    line = rows([("p", i, p) for i, p in enumerate((0, 1, 0, 0, 0, 2, 0))], "patient_id string, row_no int, priority int")
    got = timeline.drop_repeated_time_rows(line, ["row_no"], F.col("priority") == 0, 3)
    assert sorted(r["row_no"] for r in got.collect()) == [0, 1, 2, 5, 6]


def test_pairs_of_codes_by_tiles(rows):
    """Keys of no, one and many codes, in tiles smaller than their vectors."""
    rng = np.random.default_rng(8)
    cells = {(f"p{k}", t, f"c{x:03d}"): float(rng.normal()) for k in range(6) for t in range(4)
             for x in rng.choice(150, size=(0, 1, 7, 140)[t], replace=False)}
    values = rows([(*k, v) for k, v in cells.items()], "patient_id string, age_min int, code string, value double")
    want = {}
    for (p, t, a), x in cells.items():
        for (p2, t2, b), y in cells.items():
            if (p, t) == (p2, t2) and a <= b:
                want.setdefault((a, b), []).append((x, y))
    for tile in (4, 64):
        vectors = values.withColumn("__k", F.col("code"))
        pairs = simeval.tiled_pairs(vectors, ["patient_id", "age_min"], ["code", "value"], tile)
        got = {(r.x, r.y): r.n for r in pairs.groupBy(F.col("a.code").alias("x"), F.col("b.code").alias("y")).agg(
            F.count(F.lit(1)).alias("n")).collect()}
        assert got == {k: len(v) for k, v in want.items()}
    for r in simeval.correlation_matrix(values, min_pairs=4).collect():
        x, y = np.array(want[r.code_1, r.code_2]).T
        assert r.n == len(x) and (r.r is None) == (len(x) < 4)
        assert r.r is None or abs(r.r - np.corrcoef(x, y)[0, 1]) < 1e-9
    both = {(r.code_1, r.code_2): r.n_both for r in simeval.presence_pairs(values, ["patient_id"]).collect()}
    held = {}
    for p, _, a in cells:
        held.setdefault(p, set()).add(a)
    for (a, b), n in both.items():
        assert n == sum(a in h and b in h for h in held.values()) and a < b
