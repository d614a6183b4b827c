import base64
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chronoline.llm import warc

PAGES = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, "same"), (3, "http://c/\r\nX: y", ""), (4, "u", None),
         (7, "u", "Ünï\r\n\r\nWARC/1.1\r\ncode"), (None, "u", "of a null id"), (11, "u", "of a null id"), (12, "u", "x" * 300000),
         (2, "http://b/", "same")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def archive(spark, tmp_path):
    def write(pages, **options):
        frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
        warc.write_archive(warc.page_records(frame), str(tmp_path), **options)
        return warc.read_archive(spark, str(tmp_path))
    return write


def test_round_trip(spark, archive, tmp_path):
    got = archive(PAGES).select("*", warc.original_record(F.col("header"), F.col("payload")).alias("record")).collect()
    assert len(got) == len(PAGES)
    assert spark.read.parquet(f"{tmp_path}/payloads").count() == len({t or "" for _, _, t in PAGES})
    order = lambda i: (i is not None, i or 0)
    for (page, url, html), r in zip(sorted(PAGES, key=lambda p: (order(p[0]), p[2] or "")),
                                    sorted(got, key=lambda r: (order(r.record_id), r.payload)), strict=True):
        body = (html or "").encode()
        first = min((p[0] for p in PAGES if (p[2] or "") == (html or "")), key=order)
        kind = "response" if page == first else "revisit"
        assert (r.record_id, bytes(r.payload), r.digest, r.length) == (page, body, digest(html), len(body))
        assert (r.record_type, r.refers_to) == (kind, None if kind == "response" else first)
        head, rest = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest == body + b"\r\n\r\n" and int(fields["Content-Length"]) == len(body)
        assert fields.get("WARC-Target-URI") == (url and url.replace("\r\n", ""))


def test_small_payloads_stay_responses(archive):
    assert {r.record_type for r in archive(PAGES, min_revisit=100).collect()} == {"response"}


def test_damaged_payload_is_found(spark, archive, tmp_path):
    archive([(1, "u", "sound")])
    bad = spark.read.parquet(f"{tmp_path}/payloads").withColumn("payload", F.lit(b"changed")).collect()
    spark.createDataFrame(bad, "key binary, payload binary").write.mode("overwrite").parquet(f"{tmp_path}/payloads")
    with pytest.raises(PySparkException):
        warc.read_archive(spark, str(tmp_path)).collect()


def test_empty_table(archive):
    assert archive([]).count() == 0
