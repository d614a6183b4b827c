import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronoline.llm import substring


def brute(texts, window):
    docs = [(t or "").replace("\x0b", " ").replace("\t", " ").replace("\n", " ").split(" ") for t in texts]
    docs = [[w for w in d if w] for d in docs]
    count = Counter(tuple(d[i:i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = {p for i in range(len(d) - window + 1) if count[tuple(d[i:i + window])] > 1 for p in range(i, i + window)}
        out.append((len(d), len(gone), " ".join(w for i, w in enumerate(d) if i not in gone)))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    passages = [[f"p{k}w{i}" for i in range(r.choice((5, 9, 10, 17, 40)))] for k in range(6)]
    texts = []
    for _ in range(n):
        words = []
        for _ in range(r.randint(0, 8)):
            words += r.choice(passages) if r.random() < 0.5 else [f"u{r.randint(0, 3000)}" for _ in range(r.randint(1, 12))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("window,chunk,bucket", [(9, 300, 50), (9, 1 << 20, 10 ** 6), (35, 500, 100)])
def test_against_all_windows(spark, window, chunk, bucket):
    texts = corpus(window) + [None, "", "one", "a\tb\x0bc\nd " * 40, "rep " * 30, "Á " * 50] + [corpus(3)[0] * 40]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, kept string, chunk int").repartition(3)
    got = substring.repeats(docs, window=window, chunk_bytes=chunk, bucket_words=bucket).orderBy("doc_id").collect()
    want = brute(texts, window)
    assert [(r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got] == want
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_null_and_repeated_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, "w1 w2"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_words, r.kept) for r in substring.repeats(docs).collect())
    assert got == [(-1, 0, ""), (-1, 40, ""), (1, 40, ""), (1, 40, ""), (2, 2, "w1 w2")]
    assert substring.repeats(docs.where(F.lit(False))).count() == 0


def test_window_must_be_odd(spark):
    with pytest.raises(ValueError):
        substring.repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), window=10)
