"""Ordered scans equal plain windows, whatever the pieces and the layout."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoline.functions import order_stats as q
from chronoline.functions import ordered as o


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(600):
        key = "hot" if i % 3 == 0 else f"k{i % 20}"
        value = None if rng.random() < 0.4 else int(rng.integers(0, 9))
        data.append((key, int(rng.integers(0, 500)), i, value))
    return spark.createDataFrame(data, "k string, t long, id long, v int").cache()


@pytest.mark.parametrize("width,parts", [(1, 1), (37, 7), (10_000, 3)])
def test_scan_equals_window(skewed, width, parts):
    w = Window.partitionBy("k").orderBy("t", "id")
    want = skewed.select(
        "id", F.row_number().over(w).cast("long").alias("rn"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("lb"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("lx"),
        F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("fa"),
        F.lag("v").over(w).alias("lag"), F.lead("v").over(w).alias("lead"),
        F.max("v").over(Window.partitionBy("k")).alias("m"))
    v = F.col("v")
    got = o.ordered_scan(skewed.repartition(parts), ["k"], ["t", "id"], o.time_segment("t", width), {
        "rn": o.row_number(), "s": o.running_sum(v), "lb": o.last_before(v, True), "lx": o.last_before(v),
        "fa": o.first_after(v), "lag": o.lag(v), "lead": o.lead(v), "m": o.total("max", v)}).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_global_rank(skewed):
    got = o.ordered_scan(skewed, [], ["t", "id"], o.time_segment("t", 20), {"rn": o.row_number()})
    assert "__all" not in got.columns
    assert [r["rn"] for r in got.orderBy("t", "id").collect()] == list(range(1, 601))


def test_number_segment_rises_with_the_value(spark):
    values = sorted([0.0, -0.001, 0.001, -5.5, 5.5, 7.999999, 8.0, 8.1, 1e9, -1e9, 123.4, 123.5])
    frame = spark.createDataFrame([(x,) for x in values], "v double")
    got = [r[0] for r in frame.select(o.number_segment("v")).collect()]
    assert got == sorted(got)


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    data = [(g, float(x)) for g, n in (("a", 1), ("b", 2), ("c", 501)) for x in rng.normal(size=n).round(2)]
    frame = spark.createDataFrame(data, "g string, x double")
    got = q.percentiles(q.value_counts(frame, ["g"], "x"), ["g"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.975})
    for row in got.collect():
        xs = [x for g, x in data if g == row["g"]]
        assert [row["lo"], row["mid"], row["hi"]] == pytest.approx(list(np.percentile(xs, [10, 50, 97.5])))


def test_one_shuffle_of_the_rows_and_no_product(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = o.ordered_scan(skewed, ["k"], ["t", "id"], o.time_segment("t", 50),
                             {"lb": o.last_before(F.col("v"), True), "rn": o.row_number()})
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # rows once; condensed pieces: combine, order, join
    assert plan.count("Exchange hashpartitioning") == 4


def test_null_keys_and_null_order_values(spark):
    rows = [(k, x, i) for i, (k, x) in enumerate([(None, 5), (None, None), (None, 70), ("a", None), ("a", 3), ("a", 99), (None, 5)])]
    frame = spark.createDataFrame(rows, "k string, x long, i long").repartition(3)
    got = o.ordered_scan(frame, ["k"], ["x", "i"], o.time_segment("x", 10), {
        "n": o.row_number(), "s": o.running_sum(F.col("i")), "p": o.lag(F.col("i")), "q": o.lead(F.col("i")),
        "t": o.total("sum", F.lit(1))}).collect()
    assert sorted((r["i"], r["n"], r["s"], r["p"], r["q"], r["t"]) for r in got) == [
        (0, 2, 1, 1, 6, 4), (1, 1, 1, None, 0, 4), (2, 4, 9, 6, None, 4), (3, 1, 3, None, 4, 3), (4, 2, 7, 3, 5, 3),
        (5, 3, 12, 4, None, 3), (6, 3, 7, 0, 2, 4)]


def test_digits_follow_the_number_of_rows():
    assert [o.digits_for(n) for n in (0, 1_600_000, 1_600_001, 10 ** 12)] == [1, 1, 2, 6]
