"""Periodic runs of words by suffix trees.

A run is a stretch of consecutive words with smallest period q, at least
`least_words` words and `least_powers` periods long, that no neighbouring word
extends with the same period. By the runs theorem every run with two periods or more
holds its Lyndon root, the longest Lyndon word that starts at some place under the
order of words or under its reverse. So each place gives two candidates (place, root
length): the distances to the next smaller and to the next greater suffix. A candidate
is extended forwards by the longest common extension (LCE) of the two suffixes one
root apart and backwards by that of the two prefixes.

LCE and suffix order come from suffix trees built by Ukkonen's algorithm: one of the
words, one of their reversal. An Euler tour of a tree lists the depth of the branching
node between leaves; the least depth between two leaves, read from a sparse table of
range minima in constant time, is their LCE.

Before the trees, words that no run can hold are cut away without loss: every three
consecutive words of a run with four periods and six words stand at least three times
in it, so a stretch of the text ends wherever three words stand less than three times in
the document (and again inside the stretch, until nothing changes). With other bounds
(`least_powers` under 4 or `least_words` under 6) the whole text goes into the trees.
The stretches of a document share one pair of trees, parted by symbols of their own.

The work is one pass where the rows are read, without a shuffle; memory is that of one
document's trees.

Defined cases: null or empty text: no words, no runs (digest of the empty text). Null
ids and repeated rows are carried along, each row for itself. Very long texts are
whole. Equally long runs: the smallest start, then the smallest period, is named. An
empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import small_batches, table

LEAST_WORDS, LEAST_POWERS = 6, 4


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of small integers whose last one is unique.

    Nodes are numbers; node 0 is the root. `start` and `end` bound the edge into a node
    (a leaf's edge is open to the end) and `child` maps node * width + symbol to the
    node below. The leaf of suffix i is `leaf[i]`.
    """

    def __init__(self, symbols: list[int]):
        self.symbols, self.n = symbols, len(symbols)
        self.width = max(symbols, default=0) + 1
        self._build()

    def _build(self) -> None:
        text, n, width = self.symbols, self.n, self.width
        start, end, link, child, leaf = [0], [0], [0], {}, [0] * n
        node = edge = length = waiting = 0   # the active point and the suffixes still to be placed
        for i, symbol in enumerate(text):
            waiting += 1
            branch = 0                       # the inner node that waits for its suffix link
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = leaf[i - waiting + 1] = len(start)
                    start.append(i), end.append(n), link.append(0)
                    if branch:
                        link[branch] = node
                        branch = 0
                else:
                    span = min(end[below], i + 1) - start[below]
                    if length >= span:       # walk down
                        edge += span
                        length -= span
                        node = below
                        continue
                    at = start[below] + length
                    if text[at] == symbol:   # already there: the rest waits
                        length += 1
                        if branch:
                            link[branch] = node
                        break
                    middle = child[key] = len(start)
                    start.append(start[below]), end.append(at), link.append(0)
                    child[middle * width + symbol] = leaf[i - waiting + 1] = len(start)
                    start.append(i), end.append(n), link.append(0)
                    start[below] = at
                    child[middle * width + text[at]] = below
                    if branch:
                        link[branch] = middle
                    branch = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start, self.end, self.child, self.leaf = start, end, child, leaf

    def euler_tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depths met on the tour (at leaves and on every return to a branching node),
        the place of each suffix's leaf in it, and the rank of each suffix."""
        below = [[] for _ in self.start]
        for key in sorted(self.child):       # by node, then by symbol
            below[key // self.width].append(self.child[key])
        suffix = dict(zip(self.leaf, range(self.n), strict=True))
        tour, place, rank, met = [], [0] * self.n, [0] * self.n, 0
        stack = [(0, 0, iter(below[0]))]
        while stack:
            at, depth, rest = stack[-1]
            if (node := next(rest, None)) is None:
                stack.pop()
                if stack:
                    tour.append(stack[-1][1])
                continue
            if below[node]:
                stack.append((node, depth + self.end[node] - self.start[node], iter(below[node])))
                continue
            i = suffix[node]
            place[i], rank[i] = len(tour), met
            met += 1
            tour += [self.n - i, depth]
        return np.array(tour, np.int32), np.array(place, np.int64), np.array(rank, np.int64)


class Extensions:
    """Longest common extensions of suffix pairs of a sequence, each in constant time."""

    def __init__(self, symbols: list[int]):
        tour, self.place, self.rank = SuffixTree(symbols).euler_tour()
        self.levels = [tour]
        while 2 * (half := 1 << (len(self.levels) - 1)) <= len(tour):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For arrays of suffixes i <> j: how many leading symbols they share."""
        a, b = np.minimum(self.place[i], self.place[j]), np.maximum(self.place[i], self.place[j])
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][a[own]], self.levels[k][b[own] - (1 << int(k)) + 1])
        return out


def _next_below(values: list[int]) -> np.ndarray:
    """For each place the next place with a smaller value, or the length."""
    out, stack = [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def lyndon_candidates(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the longest Lyndon word from each place, under the order of the ranks and its reverse."""
    n, places = len(rank), np.arange(len(rank))
    up, down = rank.tolist(), (n - rank).tolist()
    return np.concatenate([places, places]), np.concatenate([_next_below(up) - places, _next_below(down) - places])


def tree_runs(symbols: list[int], least_words: int, least_powers: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of symbols from 0 on, in order."""
    n, last = len(symbols), max(symbols, default=0) + 1
    forward = Extensions([*symbols, last])
    place, period = lyndon_candidates(forward.rank)
    held = place + period < n                # the second suffix must start inside the words
    place, period = place[held], period[held]
    right = forward.lce(place, place + period)
    del forward
    backward = Extensions([*reversed(symbols), last])
    left, inner = np.zeros(len(place), np.int64), place > 0
    # The prefix that ends at k is the suffix n - 1 - k of the reversal.
    left[inner] = backward.lce(n - place[inner], n - place[inner] - period[inner])
    start, length = place - left, left + period + right
    long = (length >= np.maximum(least_words, least_powers * period)) & (length >= 2 * period)
    return np.unique(np.stack([start[long], length[long], period[long]], 1), axis=0)[:, [0, 1, 2]]


def _stretches(codes: np.ndarray) -> np.ndarray:
    """Mask of the words that a run of four periods and six words may hold."""
    n = len(codes)
    keep = np.ones(n, bool)
    while True:
        whole = keep[:-2] & keep[1:-1] & keep[2:]
        starts = np.flatnonzero(whole)
        # Stretches are told apart, so three words count inside their stretch only.
        stretch = np.cumsum(~keep)[starts]
        _, pairs = np.unique(codes[starts] * n + codes[starts + 1], return_inverse=True)
        _, threes = np.unique(pairs * n + codes[starts + 2], return_inverse=True)
        _, which, often = np.unique(threes * (n + 1) + stretch, return_inverse=True, return_counts=True)
        good = starts[often[which] >= 3]
        now = np.zeros(n, bool)
        for k in range(3):
            now[good + k] = True
        # A stretch also breaks between two words that no frequent three spans; such a
        # break needs no mark of its own, as the trees find no run across it.
        if (now == keep).all():
            return now
        keep = now


def runs(words: list, least_words: int = LEAST_WORDS, least_powers: int = LEAST_POWERS) -> np.ndarray:
    """Rows (start, length, period) of all runs of the words, by start, then period."""
    if len(words) < max(2, least_words, least_powers):
        return np.zeros((0, 3), np.int64)
    number: dict = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if least_words >= 6 and least_powers >= 4:
        keep = _stretches(codes)
    else:
        keep = np.ones(len(codes), bool)
    if not keep.any():
        return np.zeros((0, 3), np.int64)
    # The stretches one after another, each break as one symbol of its own.
    ends = np.flatnonzero(keep & ~np.append(keep[1:], False))
    places = np.flatnonzero(keep)
    cut = np.searchsorted(places, ends) + 1
    at = np.insert(places, cut, -1)
    symbols = np.insert(np.unique(codes[places], return_inverse=True)[1], cut, 0)
    breaks = at < 0
    symbols[breaks] = symbols.max() + 1 + np.arange(breaks.sum())
    found = tree_runs(symbols.tolist(), least_words, least_powers)
    found[:, 0] = at[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapsed(words: list, found: np.ndarray) -> list:
    """The words without those that any run repeats after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("collapsed", pa.string()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))])
FOUND_SQL = "doc_id long, n_words long, collapsed string, runs array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS,
                  least_powers: int = LEAST_POWERS, edit=None) -> DataFrame:
    """doc_id, n_words, the runs of each document and its text without repeated periods.

    `edit(doc_id, words)` may change the words (bytes) before they are searched.
    """
    def run(batches):
        for batch in batches:
            keys, counts, texts, lists = batch.column(0).to_pylist(), [], [], []
            for key, body in zip(keys, batch.column(1).cast(pa.binary()), strict=True):
                words = (body.as_py() or b"").split()   # of bytes: runs without ASCII white space
                if edit:
                    words = edit(key, words)
                found = runs(words, least_words, least_powers)
                counts.append(len(words))
                texts.append(b" ".join(collapsed(words, found)).decode())
                lists.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                (keys, counts, texts, lists), FOUND, strict=True)], schema=FOUND)

    small_batches(docs.sparkSession, 200)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, FOUND_SQL)


def planted(doc_id, words: list) -> list:
    """The words with the periodic tail that the contract gives every tenth document; null ids get none."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each document, and digests of all runs and of the collapsed text."""
    # Longest first; of equals the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(table(spark, sf_dir, "documents"), edit=planted))
