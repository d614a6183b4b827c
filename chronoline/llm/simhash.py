"""SimHash near-duplicates by exact tiled comparison.

A fingerprint has a bit set where more than half of the hashes of a text's three-word
shingles (XXH64, seed 42, repeats included) have it. Texts link at `radius` or fewer
differing bits.

Which fingerprints meet: comparing all tiles of a corpus grows with its square, so
tiles are formed inside groups. Two fingerprints that differ in at most `radius` bits
agree in one of radius + 1 blocks of their bits, so for each block the distinct
fingerprints are grouped by the low bits of that block, so many that a group holds
about `group_rows` of them, and each linked pair meets in some group. Inside a group
fingerprints are sorted by population count, cut into tiles and compared tile by tile
with numpy (exclusive or, bit count); tile pairs whose population counts lie further
apart than the radius are skipped, as such counts differ by no more than the distance.
Every comparison is one of tiles.

A group of more than `most` fingerprints is cut by population count and hash into
parts of at most about half that size, and the pairs of parts (within the radius of
population counts) become units of their own, so no task holds a group of unbounded
size and no pair is left out. Each unit gives its components as links to the least
member: never more rows than it holds, whatever the number of pairs.

`near_texts` also finds texts whose five-word shingles have a Jaccard similarity of 0.8
or more, whose fingerprints differ in up to about a dozen bits: the same tiles at a wide
radius, inside groups that share random samples of the bits, as many samples as find a
pair at that radius with the chance `found`, whatever the size of the corpus. That gives
candidate groups of classes, again as links to a least member. The whole shingle sets of
a group of two classes or more then meet once, cut into units of a bounded number of
shingles by pairs of parts; in a unit the tiles name the pairs, and those of different
classes and fitting sizes are verified exactly until they are joined. So what is emitted
is never more than the members, however many pairs a group of near copies has.

Only distinct fingerprints are compared; copies meet by equality. Components come from
`components`.

Defined cases: null text = empty text = no word = fingerprint zero, linked like any
other; fewer than three words: one shingle of the whole sequence. Null ids link and
get the component of their fingerprint; a component of null ids alone is null.
Repeated rows and other columns change nothing. Very long texts are whole, their
hashes counted in slices. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import small_batches, stored, table
from chronoline.llm.components import components

SEED, SHINGLE, RADIUS = 42, 3, 3
SLICE = 1 << 16
GROUP_ROWS, MOST, TASK_ROWS, TILE = 4000, 16_384, 200_000, 256
MOST_SHINGLES = 2_000_000
# Near texts: words of a shingle, similarity, radius of the search and chance to find a pair at that radius.
NEAR_SHINGLE, SIMILARITY, WIDE, FOUND = 5, 0.8, 13, 0.97


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as a signed 64-bit number."""
    import xxhash
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), SLICE):
        hashes = np.array([digest(x, SEED) for x in shingles[at:at + SLICE]], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and `fp` of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches):
        for batch in batches:
            found = pa.array([fingerprint(x.as_py()) for x in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], found], names=[*keep, "fp"])
    return rows.mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _key_bits(rows: int, group_rows: int, most_bits: int) -> int:
    """So many bits that groups of equal ones hold about `group_rows` of the rows."""
    return min(most_bits, max(0, math.ceil(math.log2(max(rows, 1) / group_rows))))


def block_masks(radius: int, rows: int, group_rows: int = GROUP_ROWS) -> list[int]:
    """The low bits of each of radius + 1 blocks: fingerprints within the radius agree under one of these masks."""
    edges = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    bits = _key_bits(rows, group_rows, min(b - a for a, b in zip(edges, edges[1:], strict=False)))
    return sorted({_signed(((1 << bits) - 1) << a) for a in edges[:-1]})


def sample_masks(radius: int, rows: int, group_rows: int = GROUP_ROWS, found: float = FOUND) -> list[int]:
    """Random bit samples: fingerprints `radius` bits apart agree under one of them with the chance `found`."""
    bits = _key_bits(rows, group_rows, 64 - radius)
    agree = math.comb(64 - radius, bits) / math.comb(64, bits)
    samples = 1 if agree >= found else math.ceil(math.log(1 - found) / math.log(1 - agree))
    draw = random.Random(SEED)
    return [_signed(sum(1 << b for b in draw.sample(range(64), bits))) for _ in range(samples)]


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least reachable place of each of n places over the pairs (a, b) and given labels."""
    label = np.arange(n) if label is None else label
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near_tiles(fps: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all pairs within the radius, tile pair by tile pair; each pair once."""
    bits = np.bitwise_count(fps)
    order = np.argsort(bits, kind="stable")
    sorted_fps, sorted_bits, n = fps[order], bits[order].astype(np.int64), len(fps)
    for i in range(0, n, tile):
        left = sorted_fps[i:i + tile]
        for j in range(i, n, tile):
            if sorted_bits[j] - sorted_bits[min(i + tile, n) - 1] > radius:
                break
            a, b = np.nonzero(np.bitwise_count(left[:, None] ^ sorted_fps[None, j:j + tile]) <= radius)
            if i == j:
                once = a < b
                a, b = a[once], b[once]
            if len(a):
                yield order[a + i], order[b + j]


def compare_unit(fps: np.ndarray, radius: int, tile: int = TILE) -> np.ndarray:
    """Place of the least member of its component for each of the distinct fingerprints, given sorted."""
    label = np.arange(len(fps))
    for a, b in near_tiles(fps, radius, tile):
        other = label[a] != label[b]
        if other.any():
            label = _roots(len(fps), a[other], b[other], label)
    return label


def _units(unit: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of each unit, by fingerprint, equal ones once."""
    order = np.lexsort((fps, unit))
    unit, ordered = unit[order], fps[order]
    once = ~np.r_[False, (unit[1:] == unit[:-1]) & (ordered[1:] == ordered[:-1])] if len(unit) else np.zeros(0, bool)
    order, unit = order[once], unit[once]
    yield from np.split(order, np.nonzero(unit[1:] != unit[:-1])[0] + 1) if len(order) else ()


def grouped(distinct: DataFrame, masks: list[int], radius: int, most: int = MOST) -> DataFrame:
    """The rows of `distinct` (fp and other columns) in each unit in which they are compared, with the column `unit`."""
    columns = distinct.columns
    keyed = distinct.select(*columns, F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("choice", "mask"))
    rows = stored(keyed.select(*columns, F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("group"),
                               F.bit_count("fp").cast("int").alias("ones")), "simhash")
    many = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    large = rows.join(many.select("group"), "group")
    parts = large.groupBy("group", "ones").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(most)).alias("parts"))
    tiles = parts.select("group", "ones", "parts", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("sub"))
    other = tiles.select("group", F.col("ones").alias("ones2"), F.col("sub").alias("sub2"))
    met = (tiles.join(other, "group")
           .where(F.col("ones2").between(F.col("ones"), F.col("ones") + radius))
           .where((F.col("ones2") > F.col("ones")) | (F.col("sub2") >= F.col("sub")))
           .withColumn("unit", F.xxhash64("group", "ones", "sub", "ones2", "sub2")))
    sides = met.select("group", "ones", "sub", "unit").union(met.select("group", F.col("ones2").alias("ones"),
                                                                        F.col("sub2").alias("sub"), "unit"))
    placed = large.join(parts, ["group", "ones"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("parts")))
    return (rows.join(many.select("group"), "group", "left_anti").select(*columns, F.col("group").alias("unit"))
            .union(placed.join(sides, ["group", "ones", "sub"]).select(*columns, "unit")))


def _in_tasks(units: DataFrame, task_rows: int):
    """Whole units, dealt to groups of about `task_rows` rows."""
    tasks = max(1, -(-units.count() // task_rows))
    return units.withColumn("task", F.pmod(F.hash("unit"), F.lit(tasks))).groupBy("task")


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST, task_rows: int = TASK_ROWS,
          group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) within the radius of each other."""
    units = grouped(distinct.select("fp"), block_masks(radius, distinct.count(), group_rows), radius, most)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fps, out = frame["fp"].to_numpy().view(np.uint64), []
        for rows in _units(frame["unit"].to_numpy(), fps):
            own = fps[rows]
            label = compare_unit(own, radius)
            linked = label != np.arange(len(own))
            out.append(np.stack([own[linked], own[label[linked]]], 1))
        found = (np.concatenate(out) if out else np.zeros((0, 2), np.uint64)).view(np.int64)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})
    return _in_tasks(units, task_rows).applyInPandas(run, "a long, b long")


def classes(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, class_fp) of the distinct fingerprints: the class is named by one of its members."""
    distinct = fps.select("fp").distinct()
    found = components(links(distinct, radius))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("class_fp"))


def joined_classes(named: DataFrame, more: DataFrame) -> DataFrame:
    """The classes (fp, class_fp) with those joined that the links (a, b) of fingerprints connect."""
    of = named.select(F.col("fp").alias("a"), F.col("class_fp").alias("x")).join(more, "a").join(
        named.select(F.col("fp").alias("b"), F.col("class_fp").alias("y")), "b")
    found = components(of.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return named.join(found, F.col("class_fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "class_fp").alias("class_fp"))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the text's five-word shingles (all words, where there are fewer)."""
    import xxhash
    words, digest = (text or "").encode().lower().split(), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    found = {digest(b" ".join(words[i:i + NEAR_SHINGLE]), SEED) for i in range(max(1, len(words) - NEAR_SHINGLE + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _fitting(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be that similar."""
    return np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b])


def candidate_links(known: DataFrame, similarity: float = SIMILARITY, radius: int = WIDE, found: float = FOUND, most: int = MOST,
                    task_rows: int = TASK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) of classes among (fp, class_fp, n_shingles) that hold fingerprints within the radius, of fitting sizes."""
    units = grouped(known, sample_masks(radius, known.count(), group_rows, found), radius, most)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fps, named = frame["fp"].to_numpy().view(np.uint64), frame["class_fp"].to_numpy()
        sizes, out = frame["n_shingles"].to_numpy(), [np.zeros((0, 2), np.int64)]
        for rows in _units(frame["unit"].to_numpy(), fps):
            names, of = np.unique(named[rows], return_inverse=True)
            label = np.arange(len(names))
            for a, b in near_tiles(fps[rows], radius) if len(names) > 1 else ():
                new = (label[of[a]] != label[of[b]]) & _fitting(a, b, sizes[rows], similarity)
                if new.any():
                    label = _roots(len(names), of[a[new]], of[b[new]], label)
            linked = label != np.arange(len(names))
            out.append(np.stack([names[linked], names[label[linked]]], 1))
        links_of = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": links_of[:, 0], "b": links_of[:, 1]})
    return _in_tasks(units, task_rows).applyInPandas(run, "a long, b long")


def verified_links(fps: np.ndarray, named: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> list[tuple[int, int]]:
    """Places (a, b) of similar sets that join the classes of a unit; a pair that is joined already is not compared."""
    sizes = np.array([len(x) for x in sets])
    names, of = np.unique(named, return_inverse=True)
    label, out = np.arange(len(names)), []
    for a, b in near_tiles(fps, radius):
        fit = (label[of[a]] != label[of[b]]) & _fitting(a, b, sizes, similarity)
        for x, y in zip(a[fit].tolist(), b[fit].tolist(), strict=True):
            p, q = label[of[x]], label[of[y]]
            if p == q:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= similarity * (len(sets[x]) + len(sets[y]) - both):
                label[label == max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def near_texts(texts: DataFrame, named: DataFrame, similarity: float = SIMILARITY, radius: int = WIDE,
               most_shingles: int = MOST_SHINGLES, **search) -> DataFrame:
    """Links (a, b) of fingerprints of different classes whose texts are similar, from one text of each fingerprint.

    `texts` is (fp, text), `named` (fp, class_fp). The links join all classes that similar
    texts connect. Texts of at least one word only; the similarity is exact on whole sets.
    """
    known = stored(counted(texts).join(named, "fp").where("n_shingles > 0"), "simhash-known")
    groups = components(candidate_links(known.select("fp", "class_fp", "n_shingles"), similarity, radius, **search))
    members = known.join(groups.select(F.col("node").alias("class_fp"), F.col("root").alias("group")), "class_fp").select(
        "fp", "class_fp", "group", "n_shingles")
    parts = members.groupBy("group").agg(F.ceil(F.sum("n_shingles") * 2 / F.lit(most_shingles)).alias("parts"))
    sub = F.pmod(F.xxhash64("fp"), F.col("parts"))
    # A member meets every part of its group: the units are pairs of parts.
    units = members.join(parts, "group").withColumn("sub", sub).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(
        "fp", "class_fp", F.xxhash64("group", F.least("sub", "other"), F.greatest("sub", "other")).alias("unit"))

    def sets(batches):
        for batch in batches:
            held = pa.array([shingle_set(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["fp", "held"])

    held = stored(texts.join(members.select("fp"), "fp", "left_semi").select("fp", "text").mapInArrow(
        sets, "fp long, held binary"), "simhash-sets")

    def verify(unit: pa.Table) -> pa.Table:
        fps, classes_of = unit["fp"].to_numpy(), unit["class_fp"].to_numpy()
        shingles = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit["held"]]
        pairs = verified_links(fps.view(np.uint64), classes_of, shingles, similarity, radius)
        return pa.table({"a": pa.array([fps[x] for x, _ in pairs], pa.int64()), "b": pa.array([fps[y] for _, y in pairs], pa.int64())})
    return units.join(held, "fp").groupBy("unit").applyInArrow(verify, "a long, b long")


def component_ids(fps: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): the least id of each component."""
    named = classes(fps, radius)
    least = fps.groupBy("fp").agg(F.min(doc_id).alias("least")).join(named, "fp")
    of_class = least.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    of_fp = least.join(of_class, "class_fp").select("fp", "component_id")
    return fps.join(of_fp, "fp").select(doc_id, "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
             similarity: float | None = None) -> DataFrame:
    """The documents, one of each component: that of the least id (a null id last, then
    the first stored row). Columns stay as they are.

    With a `similarity`, texts of that Jaccard similarity of five-word shingles link as well.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = stored(docs.select(F.struct(*columns).alias("__doc"), F.monotonically_increasing_id().alias("__row")), "simhash-rows")
    body, key = F.col("__doc").getField(text), F.col("__doc").getField(doc_id)
    fps = stored(fingerprints(rows.select("__row", key.alias("__key"), body.alias("__body")), ("__row", "__key"), "__body"),
                 "simhash-fps")
    best = fps.groupBy("fp").agg(F.min(F.struct(F.col("__key").isNull(), "__key", "__row")).alias("best"))
    named = classes(fps, radius)
    if similarity is not None:
        # One row stands for each fingerprint.
        first, named = best.select("fp", F.col("best.__row").alias("__row")), stored(named, "simhash-classes")
        texts = rows.join(first, "__row").select("fp", body.alias("text"))
        named = joined_classes(named, near_texts(texts, named, similarity))
    kept = (best.join(named, "fp").groupBy("class_fp").agg(F.min("best").alias("best"))
            .select(F.col("best.__row").alias("__row")))
    return rows.join(kept, "__row", "left_semi").select(
        *[F.col("__doc").getField(c).alias(c) for c in docs.columns])


def counted(texts: DataFrame) -> DataFrame:
    """(fp, n_shingles) of (fp, text)."""
    def run(batches):
        for batch in batches:
            sizes = pa.array([len(shingle_set(x.as_py())) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["fp", "n_shingles"])
    small_batches(texts.sparkSession)
    return stored(texts.select("fp", "text").mapInArrow(run, "fp long, n_shingles long"), "simhash-sizes")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = stored(fingerprints(table(spark, sf_dir, "documents")), "simhash-fps")
    return component_ids(fps).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
