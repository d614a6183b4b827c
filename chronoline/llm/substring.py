"""Repeated passages across and inside documents, by fixed-block anchors.

A passage repeats if a window of `window` words starts at two or more places of the
corpus. Reference blocks of (window + 1) / 2 words, cut at fixed distances without
overlap, are indexed: any window holds one whole block of its document, so of two
equal windows the other one holds the same words at some rolling offset. Every
rolling window of block length probes the index; block words that occur at two or
more places are anchors. Around anchors the hits are extended: each full window that
holds an anchor is compared with all others by a hash of 96 bits (two independent
rolling hashes of the words' XXH64), and runs of repeated windows merge into maximal
exact repeats. Equality of 96 bits stands for equality of words: with 10^12 candidate
windows the chance of any false one is below 10^-4.

Documents are dealt into chunks of about `chunk_bytes` of text. A chunk sends each hash
at most twice (twice stands for more than once in this chunk), packed by bucket, so a
passage that a third of all documents share costs a bucket two entries per chunk, and
buckets, sized by the measured amount of text, stay even. What comes back to a chunk
are the hashes that repeat, not pairs or places. The texts are shuffled once; all
passes read that one exchange. Nothing depends on the order of rows. Rows equal in id
and text share a chunk, as ids are taken to tell documents apart.

Defined cases: null or empty text has no words; texts shorter than a window have no
repeats. Null or repeated ids are carried along, each row is its own document, and
rows that are equal in all respects repeat each other like any copies. Very long texts
are whole. Other columns are not returned. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import small_batches, table

WINDOW = 35
CHUNK_BYTES, BUCKET_WORDS = 8 << 20, 2_000_000
BYTES_A_WORD = 6
# Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of each run of `length` entries: sum of hash * base^place modulo 2^64, mixed."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    size = 1 << int(len(hashes)).bit_length()
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * _powers(base, size)[:len(hashes)], out=sums[1:])
    inverse = _powers(pow(base, -1, 1 << 64), size)[:n]
    return mixed((sums[length:] - sums[:n]) * inverse)


class Chunk:
    """The words of a chunk's texts, one after the other."""

    def __init__(self, texts):
        import xxhash
        digest = xxhash.xxh64_intdigest
        self.words = [(t or "").encode().split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.hashes = np.fromiter((digest(w) for words in self.words for w in words), U64, int(self.sizes.sum()))
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.left = np.repeat(ends, self.sizes) - np.arange(len(self.hashes))  # words from here to the document's end

    def inside(self, length: int) -> np.ndarray:
        """Whether a run of `length` words from each place stays in its document."""
        return self.left[:max(0, len(self.hashes) - length + 1)] >= length

    def aligned(self, length: int) -> np.ndarray:
        place = np.arange(len(self.hashes)) - np.repeat(self.starts, self.sizes)
        return place[:max(0, len(self.hashes) - length + 1)] % length == 0

    def block_keys(self, block: int, buckets: int) -> np.ndarray:
        """Bucket (upper half) and 32 bits of the hash of each run of block length."""
        h = rolling(self.hashes, block, BASES[0])
        return ((h >> U64(32)) % U64(buckets) << U64(32)) | (h & U64(0xFFFFFFFF))

    def candidates(self, anchors: np.ndarray, window: int, block: int) -> np.ndarray:
        """Whether the full window at each place holds an anchor."""
        inside = self.inside(window)
        sums = np.r_[0, np.cumsum(anchors)]
        n = len(inside)
        return inside & (sums[window - block + 1:window - block + 1 + n] > sums[:n])

    def window_hashes(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        return rolling(self.hashes, window, BASES[0]), rolling(mixed(self.hashes ^ U64(BASES[1])), window, BASES[1])


def found_in(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array."""
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


PACKED = np.dtype([("a", "<u8"), ("b", "<u4")])


def _at_most_twice(keys: np.ndarray) -> np.ndarray:
    unique, counts = np.unique(keys, return_counts=True)
    return np.repeat(unique, np.minimum(counts, 2))


def _sent_blocks(frame: pd.DataFrame, buckets: int, block: int) -> pd.DataFrame:
    chunk = Chunk(frame["text"])
    keys, inside = chunk.block_keys(block, buckets), chunk.inside(block)
    probes = _at_most_twice(keys[inside])
    blocks = np.unique(keys[inside & chunk.aligned(block)])
    places = np.arange(buckets + 1, dtype=U64) << U64(32)
    p, b = np.searchsorted(probes, places), np.searchsorted(blocks, places)
    low = lambda x: x.astype(np.uint32).tobytes()
    return pd.DataFrame([(k, frame["chunk"].iloc[0], low(probes[p[k]:p[k + 1]]), low(blocks[b[k]:b[k + 1]]))
                         for k in range(buckets) if p[k] < p[k + 1]], columns=["bucket", "chunk", "probes", "blocks"])


def _anchors(frame: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, which of its probes equal an indexed block and occur at two or more places."""
    probes = [np.frombuffer(x, np.uint32) for x in frame["probes"]]
    whole = np.sort(np.concatenate(probes))
    twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
    blocks = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in frame["blocks"]]))
    twice = twice[found_in(twice, blocks)]
    hits = [np.unique(p[found_in(p, twice)]).tobytes() for p in probes]
    out = pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "hits": hits})
    return out[out["hits"].str.len() > 0]


def _sent_windows(frame: pd.DataFrame, hits: pd.DataFrame, buckets: int, window: int, block: int) -> pd.DataFrame:
    columns = ["bucket", "chunk", "windows"]
    if not len(frame) or not len(hits):
        return pd.DataFrame([], columns=columns)
    chunk = Chunk(frame["text"])
    known = np.sort(np.concatenate([np.frombuffer(x, np.uint32).astype(U64) | (U64(k) << U64(32))
                                    for k, x in zip(hits["bucket"], hits["hits"], strict=True)]))
    anchors = found_in(chunk.block_keys(block, buckets), known) & chunk.inside(block)
    wanted = chunk.candidates(anchors, window, block)
    first, second = (h[wanted] for h in chunk.window_hashes(window))
    packed = np.empty(len(first), PACKED)
    packed["a"], packed["b"] = first, (second >> U64(32)).astype(np.uint32)
    # Sorted by bucket, then by value; of equal ones two are sent.
    bucket = ((first >> U64(20)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((packed["b"], packed["a"], bucket))
    packed, bucket = packed[order], bucket[order]
    third = np.r_[False, False, (packed[2:] == packed[:-2])][:len(packed)]
    packed, bucket = packed[~third], bucket[~third]
    at = np.searchsorted(bucket, np.arange(buckets + 1))
    return pd.DataFrame([(k, frame["chunk"].iloc[0], packed[at[k]:at[k + 1]].tobytes())
                         for k in range(buckets) if at[k] < at[k + 1]], columns=columns)


def _repeated(frame: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, which of its windows occur at two or more places."""
    sent = [np.frombuffer(x, PACKED) for x in frame["windows"]]
    whole = np.concatenate(sent)
    order = np.lexsort((whole["b"], whole["a"]))
    whole = whole[order]
    same = np.r_[whole[1:] == whole[:-1], False]
    twice = np.empty(len(whole), bool)
    twice[order] = same | np.r_[False, same[:-1]]
    parts = np.split(twice, np.cumsum([len(x) for x in sent])[:-1])
    hits = [np.unique(x["a"][t]).tobytes() for x, t in zip(sent, parts, strict=True)]
    out = pd.DataFrame({"chunk": frame["chunk"], "hits": hits})
    return out[out["hits"].str.len() > 0]


def _cut(frame: pd.DataFrame, hits: pd.DataFrame, window: int) -> pd.DataFrame:
    columns = ["doc_id", "n_words", "spans", "kept"]
    if not len(frame):
        return pd.DataFrame([], columns=columns)
    chunk = Chunk(frame["text"])
    n = len(chunk.hashes)
    known = np.sort(np.concatenate([np.frombuffer(x, U64) for x in hits["hits"]])) if len(hits) else np.zeros(0, U64)
    repeats = np.nonzero(found_in(rolling(chunk.hashes, window, BASES[0]), known) & chunk.inside(window))[0]
    depth = np.zeros(n + 1, np.int64)
    depth[:n] += np.bincount(repeats, minlength=n)
    depth -= np.bincount(repeats + window, minlength=n + 1)
    gone = np.cumsum(depth)[:n] > 0
    rows = []
    for doc_id, words, start in zip(frame["doc_id"], chunk.words, chunk.starts, strict=True):
        cut = gone[start:start + len(words)]
        if cut.any():
            edges = np.flatnonzero(np.diff(np.r_[False, cut, False].astype(np.int8))).reshape(-1, 2)
            spans = [{"start": int(a), "end": int(b)} for a, b in edges]
            words_kept = [w for w, c in zip(words, cut.tolist(), strict=True) if not c]
        else:
            spans, words_kept = [], words
        rows.append((doc_id, len(words), spans, b" ".join(words_kept).decode()))
    return pd.DataFrame(rows, columns=columns)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
            chunk_bytes: int = CHUNK_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, n_words, spans (start, end in words) of the maximal repeats, and the kept words of each document."""
    if window % 2 == 0:
        raise ValueError("window must be odd, so that each holds a whole block")
    block = (window + 1) // 2
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks, buckets = 1 + size // chunk_bytes, 1 + size // BYTES_A_WORD // bucket_words
    small_batches(docs.sparkSession)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    # Ids as text: pandas would turn longs with nulls into floats.
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))

    probes = dealt.groupBy("chunk").applyInPandas(
        lambda f: _sent_blocks(f, buckets, block), "bucket int, chunk long, probes binary, blocks binary")
    anchors = probes.groupBy("bucket").applyInPandas(_anchors, "chunk long, bucket int, hits binary")
    windows = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInPandas(
        lambda f, h: _sent_windows(f, h, buckets, window, block), "bucket int, chunk long, windows binary")
    repeated = windows.groupBy("bucket").applyInPandas(_repeated, "chunk long, hits binary")
    cut = dealt.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInPandas(
        lambda f, h: _cut(f, h, window), "doc_id string, n_words long, spans array<struct<start:long,end:long>>, kept string")
    return cut.withColumn("doc_id", F.col("doc_id").cast("long"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
t AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
c AS (SELECT r, list(p) AS starts FROM p SEMI JOIN t USING (g) GROUP BY r),
x AS (SELECT r, list_sort(list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 35))))) AS gone FROM c),
k AS (SELECT d.r, doc_id, len(w) AS n, coalesce(len(gone), 0) AS m,
        array_to_string(list_filter(w, lambda v, i: NOT coalesce(list_contains(gone, i), false)), ' ') AS kept FROM d LEFT JOIN x USING (r))
SELECT doc_id, n::BIGINT AS n_words, m::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM k"""
