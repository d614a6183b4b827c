"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

The features of a text are its lower-cased words (runs of letters), its pairs of
neighbouring words and its skip-grams (pairs with one word between), hashed into
2 ** `bits` places. A feature is there or not; how often it stands and how long the
text is do not matter, so one insult weighs as much in a long text as in a short one.

Learning is follow-the-regularised-leader, one labelled row at a time: each coordinate
has a rate of its own that falls with its squared gradients, and the L1 bound keeps a
weight at zero until its gradients have added up to more than `l1`. What remains is a
sparse list of (place, weight), at most 2 ** bits rows, which is sent to all tasks.

Labelled rows are read from the whole table. The fit takes a bounded sample of about
`train_rows` ids, those of least digest, all of them where there are fewer. They are
dealt by digest to shards of about `shard_rows`; each shard is one task that holds its
rows' feature numbers only, and the weights are the mean of the shards'. Scoring is one
pass where the rows are read, without a shuffle.

Defined cases: null or empty text: no features, its score is that of the intercept.
Null ids take part in no label and count as the empty id (held out). Rows of one id: the
one with the least feature numbers is learnt; labels of one id: the greatest. A null
label teaches nothing. Repeated rows are scored each. Without labelled rows all scores
come from the intercept of the prior alone (`PRIOR`). Very long texts are whole. An empty
table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import small_batches, stored, table

LETTERS = re.compile(r"[^\W\d_]+")
BITS = 20
TRAIN_ROWS, SHARD_ROWS, EPOCHS = 24_000, 6_000, 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.1
FOLDS = 5
PRIOR = (1, 19)     # labelled rows of each class before any has been seen
CACHED_WORDS = 500_000
# Odd multipliers that spread word digests over 64 bits, one or two for each kind of feature.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                  np.uint64)


class _Digests(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = out = zlib.crc32(word.encode())
        return out


_DIGESTS = _Digests()


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Places of all words, neighbours and skip-grams of the text, repeats included."""
    words = LETTERS.findall((text or "").lower())
    h = np.fromiter(map(_DIGESTS.__getitem__, words), np.uint64, len(words)) + np.uint64(1)
    both = lambda gap, a, b: h[:-gap] * SPREAD[a] ^ (h[gap:] * SPREAD[b] >> np.uint64(7))
    mixed = np.concatenate([h * SPREAD[0], both(1, 1, 2), both(2, 3, 4)])
    mixed ^= mixed >> np.uint64(29)
    return (mixed * SPREAD[1] >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Ftrl:
    """Weights learnt by follow-the-regularised-leader; the last coordinate is the intercept, free of L1."""
    size: int
    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2
    start: float = 0.0          # of the intercept
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)
        self.bound = np.full(self.size + 1, self.l1)
        self.bound[-1] = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, bound = self.z[at], self.bound[at]
        return np.where(np.abs(z) <= bound, 0.0, (np.sign(z) * bound - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One row: its distinct places and its label."""
        at = np.append(at, self.size)
        w, n = self.weights(at), self.n[at]
        gradient = chance(self.start + float(w.sum())) - label
        rate = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha
        self.z[at] += gradient - rate * w
        self.n[at] = n + gradient * gradient


def chance(odds: float) -> float:
    """Logistic function, safe for any size of the argument."""
    return 1 / (1 + math.exp(-odds)) if odds >= 0 else (e := math.exp(odds)) / (1 + e)


def fold(doc_id: Column) -> Column:
    """Fold of an id: digest of its decimal text (empty for null); fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass(frozen=True)
class Model:
    """Intercept and the sparse weights, place by place."""
    bits: int
    intercept: float
    places: np.ndarray
    values: np.ndarray


def _sample(labels: DataFrame, train_rows: int) -> tuple[DataFrame, int, int]:
    """(doc_id, toxic) of the rows to learn from, how many, and how many of them are toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    if total > train_rows:
        # Four deviations below the bound, so that chance does not lift the sample above it.
        share = (train_rows - 4 * math.sqrt(train_rows)) / total
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    counted = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    return known, int(counted[0]), int(counted[1])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS,
        train_rows: int = TRAIN_ROWS, shard_rows: int = SHARD_ROWS, epochs: int = EPOCHS, alpha: float = ALPHA,
        beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """Weights learnt from labels (doc_id, toxic) of the folds that are not held out."""
    sample, rows, toxic = _sample(labels, train_rows)
    start = math.log((toxic + PRIOR[0]) / (rows - toxic + PRIOR[1]))
    if not rows:
        return Model(bits, start, np.zeros(0, np.int32), np.zeros(0))

    def featured(batches):
        for batch in batches:
            found = [np.unique(features(t.as_py(), bits)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())],
                                             names=["doc_id", "toxic", "places"])

    small_batches(docs.sparkSession, 200)
    # The sample holds at most `train_rows` pairs of numbers.
    joined = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
    learnt = stored(joined.mapInArrow(featured, "doc_id long, toxic int, places binary").groupBy("doc_id", "toxic").agg(
        F.min("places").alias("places")), "toxicity")
    shards = -(-rows // shard_rows)

    def train(group: pa.Table) -> pa.Table:
        model = Ftrl(1 << bits, alpha, beta, l1, l2, start)
        order = sorted(range(group.num_rows), key=lambda k: zlib.crc32(str(group["doc_id"][k].as_py()).encode()))
        rows = [(np.frombuffer(group["places"][k].as_buffer(), np.int32), group["toxic"][k].as_py()) for k in order]
        for _ in range(epochs):
            for at, label in rows:
                model.learn(at, label)
        weights = model.weights(np.arange(model.size + 1))
        at = np.append(np.flatnonzero(weights[:-1]), model.size)
        return pa.table({"place": pa.array(at, pa.int64()), "weight": pa.array(weights[at], pa.float64())})

    by_shard = learnt.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)))
    parts = by_shard.groupBy("shard").applyInArrow(train, "place long, weight double")
    # At most 2 ** bits + 1 rows; shards that left a weight at zero count as zero.
    known = parts.groupBy("place").agg((F.sort_array(F.collect_list("weight"))).alias("weights")).select(
        "place", (F.aggregate("weights", F.lit(0.0), lambda a, w: a + w) / shards).alias("weight")).orderBy("place").collect()
    weights = {r["place"]: r["weight"] for r in known}
    intercept = start + weights.pop(1 << bits, 0.0)
    return Model(bits, intercept, np.array(list(weights), np.int32), np.array(list(weights.values())))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the chance (0 to 1) that each text is toxic."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.bits, model.intercept, model.places, model.values))

    def run(batches):
        bits, intercept, places, values = sent.value
        weights = np.zeros(1 << bits)
        weights[places] = values
        for batch in batches:
            out = []
            for body in batch.column(1):
                at = features(body.as_py(), bits)
                at = np.unique(at[weights[at] != 0])
                out.append(chance(intercept + float(weights[at].sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    small_batches(spark, 200)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
