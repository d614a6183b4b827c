"""Content-addressed WARC archive.

Layout of an archive folder, both parts Parquet:

* `headers`: one row per record with its exact header block and the key of its payload;
* `payloads`: each distinct payload once, under its SHA-256.

`write_archive` digests the payloads, lets the record with the smallest id of
each payload be the `response` and all others `revisit` records that refer to it,
and moves only the response rows' payloads. Payloads shorter than `min_revisit`
bytes are kept as responses (their bytes are still stored once). `read_archive`
joins headers and payloads on the digest, computes both digests anew and compares
them with the key, the header and the header's length, so a damaged payload raises
an error instead of passing. `original_record` gives the bytes of the record as
captured: header block, payload, two line ends.

Only (id, digest, length) rows are grouped; the group of a hot payload is combined
before the shuffle by its minimum. Joins on the digest that meet a hot payload
are between one row per payload and all records, which adaptive execution splits.

Defined cases: null payload = empty payload; null URL = no target line; null id
sorts before all ids and is written as an empty number; rows that repeat the id
and payload of a response are responses too. An empty table gives an empty
archive. Other columns are not archived.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import table
from chronoline.session import shared_dir

# Names and values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"


def base32_of_hex(digest: Column, size: int = 20) -> Column:
    """Upper-case base32 of a hexadecimal digest of `size` bytes (a multiple of 5)."""
    chars = [F.substring(F.lit(BASE32), F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 10).cast("int") + 1, 1)
             for i in range(size // 5)
             for bits in [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 2), 40, "0")] for k in range(8)]
    return F.concat(*chars)


def _record_id(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


def header_block(record_id: Column, uri: Column, kind: Column, refers_to: Column, sha1: Column, length: Column,
                 date: str = DATE) -> Column:
    """The header of a record with its closing empty line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(VERSION + EOL), line("WARC-Type", kind), line("WARC-Record-ID", _record_id(record_id)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(uri, "[\\r\\n]", "")), F.lit("")),
        line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)),
                                 line("WARC-Refers-To", _record_id(refers_to)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", length.cast("string")), F.lit(EOL))


def write_archive(records: DataFrame, folder: str, min_revisit: int = 0, date: str = DATE) -> None:
    """Archive records (record_id, uri, payload binary) under `folder`."""
    rows = records.select("record_id", "uri", F.coalesce("payload", F.lit(b"")).alias("payload"))
    keyed = rows.select("record_id", "uri", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"),
                        F.octet_length("payload").cast("long").alias("length"))
    # A null id counts, and sorts first.
    first = keyed.groupBy("sha256").agg(F.max(F.col("record_id").isNull()).alias("any_null"),
                                        F.min("record_id").alias("least"))
    first = first.select("sha256", F.when(~F.col("any_null"), F.col("least")).alias("refers_to"))
    joined = keyed.join(first, "sha256")
    kind = F.when(F.col("record_id").eqNullSafe(F.col("refers_to")) | (F.col("length") < min_revisit),
                  "response").otherwise("revisit")
    headers = joined.withColumn("kind", kind).select(
        "record_id", header_block(F.col("record_id"), F.col("uri"), F.col("kind"), F.col("refers_to"),
                                  base32_of_hex(F.col("sha1")), F.col("length"), date).alias("header"),
        F.unhex("sha256").alias("key"))
    headers.write.mode("overwrite").parquet(f"{folder}/headers")
    # Rows that repeat id and payload meet in the join's own partitioning, so the
    # payload moves once and is stored once. No number is written as an empty text.
    id_key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id_key")
    owners = first.select(id_key("refers_to"), F.col("sha256").alias("wanted"))
    payloads = (rows.select(id_key("record_id"), F.sha2("payload", 256).alias("wanted"), "payload")
                .join(owners, ["id_key", "wanted"])
                .groupBy("id_key", "wanted").agg(F.first("payload").alias("payload"))
                .select(F.unhex("wanted").alias("key"), "payload"))
    payloads.write.mode("overwrite").parquet(f"{folder}/payloads")


def field(header: Column, name: str) -> Column:
    """Value of a header field, or null."""
    return F.nullif(F.regexp_extract(header, f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1), F.lit(""))


def original_record(header: Column, payload: Column) -> Column:
    """Header block, payload and the two line ends that close a record, as bytes."""
    return F.concat(F.encode(header, "UTF-8"), payload, F.lit(b"\r\n\r\n"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Records with header, payload (verified), record_type, refers_to, digest and length."""
    headers = spark.read.parquet(f"{folder}/headers")
    # Digests and lengths are taken beside the stored payload, before the join, so a
    # reader that does not ask for the bytes does not move them.
    payloads = spark.read.parquet(f"{folder}/payloads").select(
        "key", "payload", base32_of_hex(F.sha1("payload")).alias("digest"),
        F.octet_length("payload").cast("long").alias("length"),
        (F.unhex(F.sha2("payload", 256)) == F.col("key")).alias("sound"))
    h = F.col("header")
    sound = (F.coalesce("sound", F.lit(False)) & (field(h, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "digest"))
             & (field(h, "Content-Length") == F.col("length").cast("string")))
    checked = lambda c: F.when(sound, F.col(c)).otherwise(
        F.raise_error(F.concat(F.lit("payload missing, or not of its digest: "), F.hex("key")))).alias(c)
    number = lambda name: F.nullif(F.regexp_extract(field(h, name), ":(-?[0-9]*)>", 1), F.lit("")).cast("long")
    return (headers.join(payloads, "key", "left")
            .select(number("WARC-Record-ID").alias("record_id"), h, "payload", checked("digest"), checked("length"),
                    field(h, "WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to")))


def page_records(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("uri"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
    write_archive(page_records(table(spark, sf_dir, "pages")), folder)
    return read_archive(spark, folder).select(
        F.col("record_id").alias("page_id"), F.col("length").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP5_SQL = f"""
WITH d AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT body, min(page_id) AS first_id FROM d GROUP BY body),
c AS (SELECT hex, string_agg(substr('{BASE32}',
        (((('0x' || substr(hex, (k // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) & 31) + 1)::INTEGER, 1), '' ORDER BY k)
        AS b32
      FROM (SELECT DISTINCT hex FROM d), (SELECT unnest(range(32)) AS k) GROUP BY hex)
SELECT page_id, octet_length(encode(d.body))::BIGINT AS payload_bytes, c.b32 AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (body) JOIN c USING (hex)"""
