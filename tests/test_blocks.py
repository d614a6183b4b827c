"""Patient blocks: layout, plans without a shuffle of event rows, and equal results."""

import pytest
from pyspark.sql import functions as F

from chronoline.functions import ordered as o
from chronoline.operators import clean, stays
from chronoline.sources import blocks, records

SCHEMA = "patient_id string, age_min long, type int, event_id long, code string, result string, test_period int, time_available_min long, split string"


@pytest.fixture(scope="module")
def events(spark):
    cycle = ["[ADM]", "A", "LAB1", "[DSC]", "B", "[ADM]", "[DSC]", "C"]
    rows = [(f"p{k % 37}", (k * 7919) % 40_000, 1 + k % 5, k, cycle[k * 31 % 8], "", k % 3 and 1, (k * 7919) % 40_000 + k % 4 * 600,
             "train" if k % 37 < 20 else "test") for k in range(4000)]
    return spark.createDataFrame(rows + [(None, 5, 1, 9000 + i, "[ADM]", "", 1, 5, "train") for i in range(3)], SCHEMA)


@pytest.fixture(scope="module")
def stored(spark, events, tmp_path_factory):
    return blocks.write_blocks(events, str(tmp_path_factory.mktemp("blocks") / "events"), ["age_min", "type", "event_id"], buckets=8)


def plan_of(df):
    """The plan that ran, without adaptive planning's first draft."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(scan):
    parts = scan.inputRDD().filePartitions()
    return sum(len(parts.apply(k).files()) for k in range(parts.size()))


def same(a, b):
    assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(b.columns)).collect()))


def test_layout(spark, events, stored):
    assert (stored.buckets, stored.n_rows, stored.segment_minutes) == (8, 4003, None)
    same(stored.frame, events)
    files = stored.frame.select("patient_id", F.input_file_name().alias("f")).distinct().groupBy("patient_id").count()
    assert files.filter("count > 1").count() == 0
    assert stored.frame.select(F.input_file_name()).distinct().count() <= 8


def test_one_patient_reads_one_bucket(stored):
    one = records.scan_patient(stored.frame, "p7", F.lit(100), F.lit(39_000), "age_min")
    assert one.count() > 50 and one.select(F.input_file_name()).distinct().count() == 1
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert files_read(scan) == 1
    whole = stored.frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert files_read(whole) == len(stored.frame.inputFiles()) > 1


def test_scans_by_patient_do_not_move_events(events, stored):
    seg = stored.segment_minutes
    for run in (lambda d, s: stays.row_numbers(d, segment_minutes=s), lambda d, s: stays.flag_admitted(d, segment_minutes=s),
                lambda d, s: stays.complete_admissions(d, segment_minutes=s),
                lambda d, s: stays.stays(d, segment_minutes=s),
                lambda d, s: d.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))):
        got = run(stored.frame, seg)
        assert "Exchange" not in plan_of(got)
        same(got, run(events, 1440))


def test_joins_move_only_the_other_side(spark, events, stored):
    asked = events.filter("event_id % 211 = 0").select("patient_id", F.col("event_id").alias("snap"), F.col("age_min").alias("eval_min"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = clean.known_before(stored.frame, asked, segment_minutes=stored.segment_minutes)
        plan = plan_of(got)
        # The one exchange is that of the three columns of the requests.
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
        same(got, clean.known_before(events, asked, segment_minutes=1440))
        both = stored.frame.join(stored.frame.groupBy("patient_id").agg(F.max("age_min").alias("last")), "patient_id")
        assert "Exchange" not in plan_of(both)
        ids = spark.createDataFrame([("p1",), ("p2",), ("p1",)], "patient_id string")
        assert plan_of(records.scan_patients(stored.frame, ids)).count("age_min") and records.scan_patients(
            stored.frame, ids).count() == events.filter("patient_id in ('p1', 'p2')").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_and_another_session(spark, events, tmp_path):
    path = str(tmp_path / "by_split")
    blocks.write_blocks(events, path, ["age_min"], split="split", buckets=4)
    spark.sql(f"DROP TABLE {blocks._table_name(path)}")
    again = blocks.open_blocks(spark, path)
    same(again.frame, events)
    one = again.frame.filter("split = 'train' and patient_id = 'p3'")
    assert one.select(F.input_file_name()).distinct().count() == 1
    assert "Exchange" not in plan_of(stays.row_numbers(again.frame.filter("split = 'train'"), segment_minutes=None))


def test_oversized_patient_is_cut(spark, tmp_path):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 500)).alias("patient_id"),
        (F.col("id") * 37).alias("age_min"), F.lit(1).alias("type"), F.col("id").alias("event_id"))
    stored = blocks.write_blocks(rows, str(tmp_path / "hot"), ["age_min"], buckets=4, most_rows=1000)
    assert stored.largest == 10_000 and stored.segment_minutes == blocks.PIECE_MINUTES
    hot = stored.frame.filter("patient_id = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) > 1 and sum(r["count"] for r in hot) == 10_000
    same(stays.row_numbers(stored.frame, segment_minutes=stored.segment_minutes), stays.row_numbers(rows, segment_minutes=None))


def test_empty_table_and_numbers_of_buckets(spark, events, tmp_path):
    empty = blocks.write_blocks(events.limit(0), str(tmp_path / "empty"), ["age_min"])
    assert empty.frame.count() == 0 and empty.n_rows == 0 and empty.buckets & (empty.buckets - 1) == 0
    assert blocks.buckets_for(spark, 10_000_000, 1_000_000) == 16


def test_whole_and_cut_scans_agree(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("k"), F.when(F.col("id") % 11 > 0, F.col("id") * 7 % 90).alias("t"),
                                   "id", F.when(F.col("id") % 3 == 0, F.col("id")).alias("x"))
    outputs = {"n": o.row_number(), "s": o.running_sum(F.col("x")), "b": o.last_before(F.col("x")), "i": o.last_before(F.col("x"), True),
               "a": o.first_after(F.col("x")), "g": o.lag(F.col("x")), "e": o.lead(F.col("x")), "m": o.total("max", F.col("x"))}
    same(o.ordered_scan(rows, ["k"], ["t", "id"], None, outputs), o.ordered_scan(rows, ["k"], ["t", "id"], o.time_segment("t", 10), outputs))
