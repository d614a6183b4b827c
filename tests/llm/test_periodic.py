import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoline.llm import periodic

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_runs(words, least_words=6, least_powers=4):
    """Each period by itself: stretches of words equal to the word one period on."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // least_powers + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                start, length = i, j + q - i
                if length >= max(least_words, least_powers * q) and (start, length) not in seen:
                    # A smaller period of the same stretch has been seen before.
                    seen.add((start, length))
                    out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(words, *bounds):
    return [tuple(r) for r in periodic.runs(words, *bounds).tolist()]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abc", max_size=60), st.sampled_from([(6, 4), (2, 2), (5, 3), (9, 5)]))
def test_runs_of_short_words(word, bounds):
    assert found(list(word), *bounds) == brute_runs(list(word), *bounds)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_repeated_pieces(seed):
    r = random.Random(seed)
    words = []
    while len(words) < 300:
        piece = [r.choice("abcdef") for _ in range(r.randint(1, 12))]
        words += piece * r.choice((1, 1, 2, 4, 5, 9)) + piece[:r.randint(0, len(piece))]
    assert found(words) == brute_runs(words)
    assert found(words, 2, 2) == brute_runs(words, 2, 2)


def test_extensions_and_tree_against_comparison():
    r = random.Random(7)
    s = [r.randint(0, 2) for _ in range(200)] + [9]
    e = periodic.Extensions(s)
    pairs = [(i, j) for i in range(201) for j in range(201) if i != j]
    got = e.lce(*map(periodic.np.array, zip(*pairs, strict=True)))
    for (i, j), k in zip(pairs, got.tolist(), strict=True):
        assert s[i:i + k] == s[j:j + k] and s[i + k] != s[j + k]
    assert sorted(range(201), key=lambda i: s[i:]) == sorted(range(201), key=lambda i: e.rank[i])


def test_one_word_many_times():
    assert found(["a"] * 5) == [] and found(["a"] * 6) == [(0, 6, 1)] and found(["a"] * 50_000) == [(0, 50_000, 1)]


def rows(docs):
    return sorted((tuple(r) for r in periodic.digests(periodic.periodic_runs(docs, edit=periodic.planted)).collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows(docs)
    assert got == sorted((brute_row(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sum(r[1] > 0 for r in got) > 10


def test_cases(spark):
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "a b " * 20), (5, "x y " * 9), (6, "a b a b a b a b c d c d c d c d"),
             (None, "a b " * 20), (4, "a b " * 20), (7, "word " * 3000 + "tail"), (8, " ".join(map(str, range(20000)))),
             (30, "é ñ ü ß " * 30)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, runs string, start int")
    assert rows(docs) == sorted((brute_row(*x) for x in texts), key=str)
    empty = docs.where("false")
    assert rows(empty) == []
