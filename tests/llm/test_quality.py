from pyspark.sql import functions as F

import brute
from chronoline.llm import quality

CASES = [None, "", " \n\t ", "one", "a b c d e a b c d e f", "x y " * 40, "same line\nsame line\n\nother\n \n \nsame line",
         "$$$ *** ### | < > & %", "WORD!! " * 30, "Ä Ö É lower \u2003 wide", "the and of to " * 5 + "ends here.",
         "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 w1 w2 w3 w4 w5", " ".join(f"u{i}" for i in range(30000)), "the text of a day. " * 9000]


def test_counts_against_brute_force(spark):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = CASES + real
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.features(frame).collect():
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == brute.counts(texts[r.doc_id]), r.doc_id


def test_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    want = dict(zip([r.doc_id for r in rows], brute.kept([r.text for r in rows]), strict=True))
    got = {r.doc_id: r.kept for r in quality.judged(quality.features(docs)).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(k for k, v in want.items() if v)


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.judged(quality.features(spark.read.parquet(f"{sf}/documents.parquet")))
    table = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = table.where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    bad = table.where("quality = 0").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    assert good > 0.99 and bad < 0.05


def test_columns_nulls_and_empty_table(spark):
    docs = spark.createDataFrame([(None, None, "a", 1), (1, "the good text of a day and of a night.", "b", 2),
                                  (1, "the good text of a day and of a night.", "b", 2)],
                                 "doc_id long, text string, kept string, code int")
    assert [r.doc_id for r in quality.keep_good(docs).collect()] == [1, 1]
    assert quality.keep_good(docs).columns == docs.columns
    nothing = docs.where(F.lit(False))
    assert quality.judged(quality.features(nothing)).count() == 0 and quality.keep_good(nothing).count() == 0
