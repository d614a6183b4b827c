import math
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from chronoline.llm import toxicity

MASK = (1 << 64) - 1
K = [int(x) for x in toxicity.SPREAD]


def brute_features(text, bits=toxicity.BITS):
    """Distinct places, in whole numbers."""
    h = [zlib.crc32(w.encode()) + 1 for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    mixed = [x * K[0] & MASK for x in h]
    for gap, a, b in ((1, 1, 2), (2, 3, 4)):
        mixed += [(x * K[a] & MASK) ^ ((y * K[b] & MASK) >> 7) for x, y in zip(h, h[gap:], strict=False)]
    return sorted({((m ^ (m >> 29)) * K[1] & MASK) >> (64 - bits) for m in mixed})


def brute_model(rows, epochs=toxicity.EPOCHS):
    """Chance of a text by the textbook algorithm, one coordinate at a time; rows (doc_id, text, toxic)."""
    toxic = sum(y for *_, y in rows)
    start = math.log((toxic + 1) / (len(rows) - toxic + 19))
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        bound = 0.0 if i == "intercept" else toxicity.L1
        if abs(z[i]) <= bound:
            return 0.0
        return -(z[i] - math.copysign(bound, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    def chance(places):
        return 1 / (1 + math.exp(-(start + sum(weight(i) for i in places))))
    rows = sorted(rows, key=lambda r: zlib.crc32(str(r[0]).encode()))
    for _ in range(epochs):
        for _, text, y in rows:
            at = [*brute_features(text), "intercept"]
            g = chance(at) - y
            for i in at:
                w = weight(i)
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w
                n[i] += g * g
    return lambda text: chance([*brute_features(text), "intercept"])


def held_out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def test_scores_against_plain_learning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [(r.doc_id, texts[r.doc_id], r.toxic) for r in labels.collect() if not held_out(r.doc_id)]
    model = brute_model(rows)
    got = {r.doc_id: r for r in toxicity.op13_toxicity(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        assert abs(got[i].score - model(text)) < 1e-9
        assert got[i].held_out == held_out(i) and got[i].predicted == (got[i].score >= 0.5)


def test_held_out_rows_of_a_larger_table(spark):
    scored = toxicity.op13_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    found = scored.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count()
    n = {(r.toxic, r.predicted): r["count"] for r in found.collect()}
    # A tenth of the labels marks texts without any insult as toxic.
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def corpus(spark, n=400):
    rows = [(i, ("calm words of number %d " % i) * 3 + ("you vile brute" if i % 3 == 0 else ""), i % 3 == 0) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x", 0.5, "y") for i, t, _ in rows],
                                 "doc_id long, text string, toxic string, score double, places string")
    return docs, spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, toxic int")


def predicted(docs, model):
    return {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}


def test_sample_and_shards(spark):
    docs, labels = corpus(spark, 900)
    sample, rows, toxic = toxicity._sample(labels, 300)
    assert rows == sample.count() <= 300 and rows > 150 and toxic == sample.where("toxic = 1").count()
    assert sample.where(toxicity.fold(F.col("doc_id")) == 0).count() == 0
    model = toxicity.fit(docs, labels, shard_rows=250, l1=2.0)
    got = predicted(docs, model)
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in got.items())
    # Sparse: most of the numbers in the texts have no weight.
    assert 0 < len(model.places) < 400


def test_cases(spark):
    docs, labels = corpus(spark)
    more = spark.createDataFrame(
        [(5001, None), (5002, ""), (None, "vile brute"), (3, "another row of this id"), (5003, "calm " * 200_000 + "you vile brute")],
        "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    odd = labels.union(spark.createDataFrame([(3, 0), (6, None), (None, 1), (9999, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(both, odd, l1=2.0)
    got = toxicity.score(both, model).collect()
    assert len(got) == both.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[5001] == by_id[5002] < 0.5 < by_id[5003]
    assert toxicity.score(both.where("false"), model).count() == 0


def test_no_labels(spark):
    docs, labels = corpus(spark, 10)
    model = toxicity.fit(docs, labels.where("false"))
    assert all(abs(s - 1 / 20) < 1e-12 for s in predicted(docs, model).values())
    assert toxicity.fit(docs.where("false"), labels).places.size == 0
