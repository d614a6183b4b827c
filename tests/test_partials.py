"""Partial statistics of runs: merged and folded runs equal one full run."""

import pytest
from pyspark.sql import functions as F

from chronoline.operators import partials

KEYS = ["code", "split"]


def records(spark, n=3000):
    rows = [(f"c{k % 7}" if k % 50 else None, ("train", "test")[k % 2], f"p{k * 31 % 400}", None if k % 11 == 0 else k % 13 + 0.5,
             None if k % 17 == 0 else f"t{k % 5}", k % 3) for k in range(n)]
    return spark.createDataFrame(rows, "code string, split string, patient_id string, x double, kind string, day int")


def shown(df, keys=KEYS):
    """The exact part of the rows; estimates depend on the order of merging and are checked on their own."""
    return sorted((str([r[k] for k in keys]), r.n, r.n_values, r.total, r.squares, tuple(sorted(r.categories.items())))
                  for r in df.collect())


def near(df, records, keys=KEYS):
    exact = records.groupBy(*keys).agg(F.count_distinct("patient_id").alias("exact")).withColumn("k", F.struct(*keys).cast("string"))
    got = df.select(F.struct(*keys).cast("string").alias("k"), F.hll_sketch_estimate("patients").alias("estimate"))
    return all(abs(r.exact - r.estimate) <= 1 + 0.05 * r.exact for r in exact.join(got, "k").collect())


def test_three_runs_equal_one(spark, tmp_path):
    df, path = records(spark), str(tmp_path / "runs")
    whole = partials.partial_counts(df, KEYS, "x", "kind")
    parts = [partials.partial_counts(df.filter(F.col("day") == k), KEYS, "x", "kind") for k in range(3)]
    for k, part in enumerate(parts):
        partials.add_run(part, path, f"r{k}")
    stored = partials.stored_runs(spark, path)
    assert {r.run for r in stored.select("run").distinct().collect()} == {"r0", "r1", "r2"}
    assert shown(partials.merged(stored, KEYS)) == shown(whole)
    # Coarser keys are unions of finer ones.
    assert shown(partials.merged(stored, ["code"]), ["code"]) == shown(partials.partial_counts(df, ["code"], "x", "kind"), ["code"])
    assert near(partials.merged(stored, KEYS), df) and near(partials.merged(stored, ["code"]), df, ["code"])
    totals = partials.totals_of(parts[0], "r0")
    for k in (1, 2):
        totals = partials.fold(totals, parts[k], f"r{k}", KEYS)
    assert shown(totals) == shown(whole) and near(totals, df)
    with pytest.raises(Exception, match="already"):
        partials.add_run(parts[1], path, "r1")
    with pytest.raises(Exception, match="in the totals already"):
        partials.fold(totals, parts[1], "r1", KEYS).collect()


def test_counts_are_those_of_the_rows(spark):
    df = records(spark)
    got = {(r.code, r.split): r for r in partials.finished(partials.partial_counts(df, KEYS, "x", "kind")).collect()}
    rows = [r for r in df.collect() if r.code == "c3" and r.split == "test"]
    x = [r.x for r in rows if r.x is not None]
    r = got["c3", "test"]
    assert (r.n, r.n_values) == (len(rows), len(x)) and r.mean == pytest.approx(sum(x) / len(x))
    assert r.std == pytest.approx((sum(v * v for v in x) / len(x) - (sum(x) / len(x)) ** 2) ** 0.5)
    assert r.categories == {k: sum(q.kind == k for q in rows) for k in {q.kind for q in rows} - {None}}
    exact = len({q.patient_id for q in rows})
    assert abs(r.n_patients - exact) <= 1 + 0.05 * exact and (None, "train") in got


def test_keys_of_one_side_and_empty_runs(spark):
    df = records(spark, 100)
    a, b = partials.partial_counts(df.filter("code = 'c1'"), KEYS, "x"), partials.partial_counts(df.filter("code = 'c2'"), KEYS, "x")
    both = partials.fold(partials.totals_of(a, "a"), b, "b", KEYS)
    assert {(r.code, tuple(r.runs)) for r in both.collect()} == {("c1", ("a",)), ("c2", ("b",))}
    empty = partials.partial_counts(df.filter("false"), KEYS, "x", "kind")
    assert empty.count() == 0 and partials.merged(empty, KEYS).count() == 0
    assert shown(partials.fold(partials.totals_of(a, "a"), empty, "e", KEYS)) == shown(a)
