"""Smoothing by prefix moments against the plain weighted fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoline.operators import metrics, smoothing


def brute(prob, n, pos, x, frac, spread):
    d = np.abs(prob - x)
    order = np.argsort(d, kind="stable")
    k = max(1, int(np.floor(frac * n.sum() + 1e-10)))
    r = d[order][np.searchsorted(np.cumsum(n[order]), k)]
    w = np.where(d <= 0.999 * r, np.where(d <= 0.001 * r, 1.0, (1 - (d / r if r else d) ** 3) ** 3), 0.0)
    if not w.any():
        return r, None
    sw, sx, sy = (w * n).sum(), (w * n * (prob - x)).sum(), (w * pos).sum()
    sxx, sxy = (w * n * (prob - x) ** 2).sum(), (w * pos * (prob - x)).sum()
    var, cov = sxx / sw - (sx / sw) ** 2, sxy / sw - sx / sw * sy / sw
    return r, sy / sw if np.sqrt(max(var, 0)) <= 0.001 * spread else sy / sw - cov / var * sx / sw


def samples():
    r = np.random.default_rng(5)
    yield "even", r.uniform(0.0001, 0.9999, 900), r.integers(1, 4, 900)
    yield "rare", np.clip(10.0 ** r.uniform(-5, -0.02, 700), 1e-4, 0.9999), r.integers(1, 3, 700)
    yield "steps", np.arange(1, 65) / 64, r.integers(1, 500, 64)
    yield "tied", np.array([1e-4, 0.02, 0.021, 0.3, 0.31, 0.32, 0.9]), np.array([50, 3, 4, 2, 2, 5, 9])
    yield "tight", 0.5 + r.uniform(-1e-7, 1e-7, 300).cumsum() * 1e-3, np.ones(300, int)
    yield "one", np.array([0.25]), np.array([7])


@pytest.mark.parametrize("name,prob,n", list(samples()), ids=lambda v: v if isinstance(v, str) else "")
def test_equals_the_plain_fit(spark, name, prob, n):
    prob, first = np.unique(prob, return_index=True)
    n = n[first]
    pos = np.minimum(n, (prob * n * 1.7).round().astype(int))
    counts = spark.createDataFrame([("k", float(p), int(a), int(b)) for p, a, b in zip(prob, n, pos, strict=True)],
                                   "grp string, prob double, n long, pos long").repartition(3)
    # Some cases are scanned in pieces, some as a whole.
    got = {r.g: r for r in metrics.lowess_curve(counts, ["grp"], few_values=name in ("steps", "tight", "one")).collect()}
    spread = prob.max() - prob.min()
    for g in range(max(1, int(np.ceil(spread / 0.005)))):
        x = prob.min() + g * 0.005
        want = brute(prob, n, pos, x, 0.5, spread)[1]
        assert (g in got) == (want is not None)
        if want is None:
            continue
        row = got[g]
        assert row.x == pytest.approx(x, abs=1e-15)
        assert row.smooth == pytest.approx(want, abs=1e-8 if name == "tight" else 1e-9)


def test_bandwidths_and_rows_of_a_grid_point(spark):
    r = np.random.default_rng(2)
    for size in (300, 6000):
        prob = np.unique(r.beta(0.4, 3, size))
        counts = spark.createDataFrame([(0, float(p), 1 + k % 3, k % 2) for k, p in enumerate(prob)], "k int, prob double, n long, pos long")
        grid = spark.range(0, 200).select(F.lit(0).alias("k"), F.col("id").cast("int").alias("g"), (F.col("id") * 0.005).alias("x"))
        near = smoothing.bandwidths(counts, grid, ["k"], 0.5)
        n = np.array([1 + k % 3 for k in range(len(prob))])
        for row in near.collect():
            assert row.r == brute(prob, n, n, row.x, 0.5, 1.0)[0]
        # However many values there are, a grid point meets a bounded number of rows.
        most = smoothing.window_terms(counts, near, ["k"]).groupBy("g").count().agg(F.max("count")).first()[0]
        assert most <= 16


def test_keys_null_and_empty(spark):
    rows = [(None, p / 50, 1, p % 2) for p in range(1, 50)] + [("b", 0.5, 2, 1)]
    counts = spark.createDataFrame(rows, "grp string, prob double, n long, pos long")
    assert {r.grp for r in metrics.lowess_curve(counts.filter("grp = 'b'"), ["grp"]).collect()} == {"b"}
    whole = metrics.lowess_curve(counts.filter("grp is null").drop("grp"))
    assert whole.columns == ["g", "x", "smooth"] and whole.count() == 192
    assert metrics.lowess_curve(counts.filter("false"), ["grp"]).count() == 0


def test_stored_counts_lose_no_point(spark, tmp_path):
    """Scans of one stored table share exchanges; unions above them must not rely on their partitioning."""
    path = str(tmp_path / "counts")
    spark.range(5 * 900).selectExpr("id % 5 as replicate", "(id div 5 + 1) / 1000 as prob", "1L as n", "cast(id % 3 = 0 as bigint) as pos").write.parquet(path)
    counts = spark.read.parquet(path)
    grid = counts.select("replicate").distinct().selectExpr("replicate", "explode(sequence(0, 99)) as g").selectExpr(
        "replicate", "g", "0.001 + g * 0.009 as x", "0.9 as range")
    assert smoothing.lowess(counts, grid, ["replicate"], 0.5, True).count() == 500
