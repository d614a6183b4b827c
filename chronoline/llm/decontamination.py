"""Benchmark decontamination: which documents hold a test item.

A document holds an item if it has at least `percent` of the item's distinct shingles
(five lower-cased words; an item of fewer words is one shingle of all its words).

Short items inside long documents have tiny resemblance, so signatures of whole
documents would miss them. Items are partitioned by their number m of shingles, and
each keeps the least m - ceil(percent m) + 1 values of a hash over its shingles: a
MinHash sketch just larger than what a holding document may lack. By the pigeonhole
principle such a document has at least one value of the sketch, and at least
k - (m - ceil(percent m)) of k, so the search loses nothing. The shingle hashes of
documents up to the largest sketch value probe the sketches; pairs with enough values
are verified by exact comparison of shingle texts.

Candidate search, verification and joins work on distinct texts (by SHA-256), so a
third of the table being copies of one text costs one text. The sketches are
broadcast only if counted to hold at most `BROADCAST_ROWS` values; beyond, they are
an ordinary join side. The texts of candidates are fetched by a sort-merge join at any
size, as their number grows with the corpus.

Defined cases: null, empty or blank texts hold nothing and are held by nothing. Null
ids and repeated rows appear as often as they occur; items of equal text each count.
Very long texts are whole. Other columns are ignored by `contained`, kept by
`decontaminate`. An empty benchmark or table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import let, stored, table, words_of

SHINGLE, PERCENT = 5, 80
BROADCAST_ROWS = 2_000_000
SALTS = 32


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shingle_hashes(words: Column, size: int) -> Column:
    """A hash of each run of `size` words."""
    def of(hashes):
        return F.when(F.size(hashes) >= size, F.transform(
            F.sequence(F.lit(0), F.size(hashes) - size),
            lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(k)) for k in range(size)]))).otherwise(
                F.array().cast("array<bigint>"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def shingle_texts(words: Column, size: int) -> Column:
    """The distinct runs of `size` words, joined by a blank."""
    def of(w):
        return F.when(F.size(w) >= size, F.array_distinct(F.transform(
            F.sequence(F.lit(0), F.size(w) - size),
            lambda i: F.concat_ws(" ", *[F.get(w, i + F.lit(k)) for k in range(size)])))).otherwise(
                F.array().cast("array<string>"))
    return let(words, of)


def _by_size(size: Column, of) -> Column:
    """`of(k)` for the value k = 1..SHINGLE of a column."""
    out = F.when(size == 1, of(1))
    for k in range(2, SHINGLE + 1):
        out = out.when(size == k, of(k))
    return out


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """item, shingle size, shingle texts, m, and the sketch with the hits it needs."""
    words = items.select("item_id", words_of(F.lower("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(SHINGLE))
    shingled = words.select("item_id", size.alias("size"), _by_size(size, lambda k: shingle_texts(F.col("w"), k)).alias("texts"),
                            F.array_distinct(_by_size(size, lambda k: shingle_hashes(F.col("w"), k))).alias("hashes"))
    m = F.size("texts")
    lacking = m - F.ceil(m * percent / F.lit(100)).cast("int")
    return shingled.select("item_id", "size", "texts", m.alias("m"), lacking.alias("lacking"),
                           F.slice(F.sort_array("hashes"), F.lit(1), lacking + 1).alias("sketch"))


def candidates(docs: DataFrame, index: DataFrame, text: str = "text") -> DataFrame:
    """(digest, item_id): texts that hold enough values of an item's sketch. `index` is a stored `sketches`."""
    facts = index.agg(F.sum(F.size("sketch").cast("long")), F.max(F.array_max("sketch")),
                      F.collect_set("size")).first()  # three facts, at most SHINGLE sizes
    values, ceiling, sizes = facts[0] or 0, facts[1], sorted(facts[2])
    probes = index.select("item_id", "size", F.explode("sketch").alias("h"))
    probes = F.broadcast(probes) if values <= BROADCAST_ROWS else probes
    keyed = docs.where(F.col(text).isNotNull()).select(
        digest_of(F.col(text)).alias("digest"), words_of(F.lower(F.col(text))).alias("w"))

    def below_ceiling(k):
        hashes = F.array_distinct(F.filter(shingle_hashes(F.col("w"), k), lambda h: h <= F.lit(ceiling)))
        return F.transform(hashes, lambda h: F.struct(F.lit(k).alias("size"), h.alias("h")))

    if not sizes:
        return keyed.where(F.lit(False)).select("digest", F.lit(0).cast("long").alias("item_id"))
    hits = (keyed.select("digest", F.explode(F.flatten(F.array(*[below_ceiling(k) for k in sizes]))).alias("x"))
            .select("digest", "x.size", "x.h")
            .join(probes, ["size", "h"]).select("digest", "item_id", "h").distinct()
            .groupBy("digest", "item_id").agg(F.count(F.lit(1)).alias("hits")))
    return (hits.join(index.select("item_id", F.size("sketch").alias("k"), "lacking"), "item_id")
            .where(F.col("hits") >= F.col("k") - F.col("lacking")).select("digest", "item_id"))


def _shared(text: Column, size: Column, texts: Column) -> Column:
    """How many of an item's shingles a text holds."""
    return F.size(F.array_intersect(texts, _by_size(size, lambda k: shingle_texts(words_of(F.lower(text)), k))))


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()


def contained(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row for each document and each item that it holds."""
    index = stored(sketches(_items(benchmark, item_id, item_text), percent), "sketches")
    pairs = stored(candidates(docs, index, text), "candidates")
    # Copies of a frequent text are spread over salts, the few candidates repeated for each.
    salted = pairs.select("digest").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = docs.where(F.col(text).isNotNull()).select(
        digest_of(F.col(text)).alias("digest"), F.col(text).alias("__text"),
        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    wanted = spread.join(salted.hint("merge"), ["digest", "salt"], "left_semi").drop("salt").dropDuplicates(["digest"])
    held = wanted.join(pairs, "digest").join(index.select("item_id", "size", "texts", "m"), "item_id").select(
        "digest", "item_id", F.col("m").cast("long").alias("n_shingles"),
        _shared(F.col("__text"), F.col("size"), F.col("texts")).cast("long").alias("n_shared"))
    found = stored(held.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent), "contained")
    ids = docs.select(F.col(doc_id).alias("doc_id"), digest_of(F.col(text)).alias("digest"))
    return ids.join(found, "digest").select(
        "doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that hold no item, columns as they are.

    Documents meet the candidate items of their text, at most the benchmark's
    number, in one join and are verified there, so texts move once.
    """
    index = stored(sketches(_items(benchmark, "item_id", "text"), percent), "sketches")
    pairs = stored(candidates(docs, index, text), "candidates")
    suspects = pairs.join(index, "item_id").groupBy(F.col("digest").alias("__digest")).agg(
        F.collect_list(F.struct("size", "texts", "m")).alias("__items"))
    holds = F.exists("__items", lambda x: _shared(F.col(text), x["size"], x["texts"]) * 100 >= x["m"] * percent)
    return (docs.withColumn("__digest", digest_of(F.col(text))).join(suspects.hint("merge"), "__digest", "left")
            .where(~F.coalesce(holds, F.lit(False))).drop("__digest", "__items"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (SELECT text, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT text FROM documents)),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM i WHERE len(w) > 0)),
m AS (SELECT item_id, k, count(*) AS m FROM s GROUP BY ALL),
g AS (SELECT DISTINCT text, k, array_to_string(w[p:p + k - 1], ' ') AS g
      FROM (SELECT text, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM m) WHERE len(w) >= k)),
c AS (SELECT text, item_id, count(*) AS n FROM g JOIN s USING (k, g) GROUP BY ALL)
SELECT doc_id, item_id, m::BIGINT AS n_shingles, n::BIGINT AS n_shared, n / m AS containment
FROM c JOIN m USING (item_id) JOIN documents USING (text) WHERE 100 * n >= 80 * m"""
