import pytest
from pyspark.sql import functions as F

from chronoline.functions import scalars as c


def one(spark, expr, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(expr.alias("x")).first()["x"]


def test_age_components_and_back(spark):
    age = 25_920 * 1440 + 13 * 60 + 52
    frame = spark.range(1).select(F.lit(age).alias("a"))
    parts = frame.select(*[v.alias(k) for k, v in c.age_components("a").items()])
    got = parts.first().asDict()
    want = {"years": 71 / 120, "months": 0.0, "days": 5 / 29, "hours": 13 / 23, "minutes": 52 / 59}
    assert got == pytest.approx(want)
    assert parts.select(c.components_to_age().alias("x")).first()["x"] == age


@pytest.mark.parametrize("prev,new,label", [
    (0, 0, 0), (0, 9, 0), (0, 10, 1), (0, 1439, 143), (0, 1440, 144), (0, 1801 * 1440, 1560),
    (0, 1800 * 1440, 144 + 30 * 24 + 15 * 24 + 6 * 24 + 7 * 24), (600, 600 + 1440 + 70, 144 + 11),
])
def test_time_bin_label(spark, prev, new, label):
    assert one(spark, c.time_bin_label("p", "n"), p=prev, n=new) == label


def test_number_of_time_bins():
    assert c.n_time_bins(10, 60) == 1561


@pytest.mark.parametrize("text,number", [
    ("145.2 mEq/L", 145.2), ("(1+)", None), ("-3e2 x", -300.0), (".5", 0.5), ("", None)])
def test_leading_number(spark, text, number):
    assert one(spark, c.leading_number("t"), t=text) == number


def test_segment_code(spark):
    frame = spark.range(1).select(F.lit("J156").alias("c"))
    got = frame.select(*[p.alias(str(i)) for i, p in enumerate(c.segment_code("c", [1, 2, 1, 1]))]).first()
    assert tuple(got) == ("J", "*15", "***6", "")


def test_age_text_round_trip(spark):
    frame = spark.range(0, 3_000_000, 7_919).select(F.col("id").alias("a"))
    bad = frame.filter(c.parse_age_text(c.age_text("a")) != F.col("a")).count()
    assert bad == 0
    assert one(spark, c.age_text("a"), a=12 * 365 * 1440 + 94 * 1440 + 306) == "12Y/3M/4D 05:06"
    assert one(spark, c.parse_age_text("t"), t="no age") is None


def test_nearest_bin_takes_smallest_on_ties(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 4.0], 3.0)], "g array<double>, v double")
    assert frame.select(c.nearest_bin("v", "g").alias("x")).first()["x"] == 1


def test_codes(spark):
    assert one(spark, c.normalize_code("t"), t=" c50.1 ") == "C501"
    assert one(spark, c.code_group("t"), t="Z12.5") == "Z125"
    assert one(spark, c.code_group("t"), t="C50.1") == "C50"
    assert one(spark, c.normalize_sex("t"), t="[F]") == "female"
    assert one(spark, c.normalize_sex("t"), t="[O]") is None
