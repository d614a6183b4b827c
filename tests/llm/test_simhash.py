import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chronoline.llm import simhash


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    for c in b"\t\n\x0b\x0c\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, radius=3):
    """items: (id, fp); least id reachable, by exhaustive comparison."""
    found = {i: i for i in range(len(items))}

    def root(i):
        while found[i] != i:
            i = found[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                found[b] = a
    least = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return [least.get(root(i)) for i in range(len(items))]


def test_fingerprint():
    for text in (None, "", "one", "One two", "a b\tc", "Á É A Z a z " * 50, " x\x0by\x0cz\r\nx y z w"):
        assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text), text
    slow = simhash.SLICE
    simhash.SLICE, long = 7, "the quick brown fox jumps over a lazy dog again " * 20
    try:
        assert simhash.fingerprint(long) % (1 << 64) == brute_fingerprint(long)
    finally:
        simhash.SLICE = slow


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_set(n, seed):
    r = random.Random(seed)
    base = [r.getrandbits(64) for _ in range(n // 6)]
    return [(k, r.choice(base) ^ sum(1 << b for b in r.sample(range(64), r.choice((0, 1, 2, 3, 4))))) for k in range(n)]


def compare(spark, items, **options):
    fps = spark.createDataFrame([(k, signed(f)) for k, f in items], "doc_id long, fp long")
    found = simhash.components(simhash.links(fps.select("fp").distinct(), **options))
    pairs = {r.node: r.root for r in found.collect()}
    groups = {}
    for (_, f), c in zip(items, brute_components(items), strict=True):
        groups.setdefault(c, set()).add(pairs.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_every_link_is_found(spark):
    compare(spark, near_set(600, 1))


def test_large_groups_are_cut_without_loss(spark):
    r = random.Random(2)
    items = [(k, (0xABCDEF << 40) | r.getrandbits(22)) for k in range(1500)]
    compare(spark, items, most=64, task_rows=500)


def test_tiles_against_all_pairs():
    fps = np.unique(np.array([f for _, f in near_set(900, 3)], dtype=np.uint64))
    want = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    assert simhash.compare_unit(fps, 3, tile=50).tolist() == want


def test_tables_links_come_from_tiles(spark):
    """Every link of a whole table, and nothing else, is found by comparing tiles."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fps = np.array([r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()], np.int64).view(np.uint64)
    want = {(i, i + 1 + int(j)) for i in range(len(fps)) for j in np.nonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 3)[0]}
    masks = [np.uint64(m % (1 << 64)) for m in simhash.block_masks(3, len(fps), 100)]
    got = set()
    for m in masks:
        for rows in simhash._units((fps & m).view(np.int64), fps):
            for a, b in simhash.near_tiles(fps[rows], 3):
                got |= {(min(x, y), max(x, y)) for x, y in zip(rows[a].tolist(), rows[b].tolist(), strict=True)}
    assert len(masks) == 4 and want and got == want
    found = {r.node: r.root for r in simhash.components(simhash.links(
        spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), group_rows=100)).collect()}
    linked = {int(fps.view(np.int64)[i]) for pair in want for i in pair}
    assert set(found) == linked


def test_masks():
    assert simhash.block_masks(3, 100) == [0] and len(simhash.block_masks(3, 10 ** 6)) == 4
    r = random.Random(4)
    for rows in (10 ** 4, 10 ** 6, 10 ** 8):
        masks = [m % (1 << 64) for m in simhash.sample_masks(13, rows)]
        apart = [sum(1 << b for b in r.sample(range(64), 13)) for _ in range(2000)]
        assert sum(any(not d & m for m in masks) for d in apart) >= 0.95 * len(apart)


def brute_similar(texts, least=0.8):
    """Pairs of places of different texts with that Jaccard similarity of five-word shingles."""
    sets = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    posted = {}
    for i, held in enumerate(sets):
        for s in held:
            posted.setdefault(s, []).append(i)
    shared = {}
    for at in posted.values():
        for x, i in enumerate(at):
            for j in at[x + 1:]:
                shared[i, j] = shared.get((i, j), 0) + 1
    return {(i, j) for (i, j), n in shared.items() if n >= least * (len(sets[i]) + len(sets[j]) - n)}


def test_recall_of_similar_texts(spark):
    """Of all pairs of different texts of the largest table, by posting lists, 0.9 and more end in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = {}
    for r in docs.collect():
        rows.setdefault(simhash.fingerprint(r.text), r.text)
    fps, texts = list(rows), list(rows.values())
    want = [(fps[i], fps[j]) for i, j in brute_similar(texts)]
    table = spark.createDataFrame(list(zip(fps, texts, strict=True)), "fp long, text string")
    three = simhash.stored(simhash.classes(table), "classes")
    more = simhash.near_texts(table, three)
    named = {r.fp: r.class_fp for r in simhash.joined_classes(three, more).collect()}
    assert len(want) >= 40 and sum(named[a] == named[b] for a, b in want) >= 0.9 * len(want)
    # Links are exact: no pair is joined by `more` that is not similar.
    assert {tuple(sorted(x)) for x in more.collect()} <= {tuple(sorted(p)) for p in want}


def test_group_of_near_copies_is_joined_by_few_links(spark):
    """Hundreds of copies, each with words of its own, in units of few shingles: links do not outnumber the members."""
    base, r = [f"w{i}" for i in range(200)], random.Random(1)
    texts = []
    for k in range(300):
        words = list(base)
        for at in r.sample(range(200), 2):
            words[at] = f"own{k}_{at}"
        texts.append(" ".join(words))
    rows = {simhash.fingerprint(t): t for t in texts}
    table = spark.createDataFrame(list(rows.items()), "fp long, text string")
    three = simhash.stored(simhash.classes(table), "classes")
    pairs = brute_similar(list(rows.values()))
    group = list(range(len(rows)))
    for _ in range(3):
        for i, j in sorted(pairs):
            group[i] = group[j] = min(group[i], group[j])
    whole = simhash.near_texts(table, three)
    cut = simhash.near_texts(table, three, most_shingles=20_000)
    assert len(pairs) > 2000 and whole.count() < len(rows) and cut.count() < 8 * len(rows)
    fps = list(rows)
    for more in (whole, cut):
        named = {x.fp: x.class_fp for x in simhash.joined_classes(three, more).collect()}
        together = sum(named[fps[i]] == named[fps[j]] for i, j in pairs)
        assert together >= 0.9 * len(pairs)


def test_similar_texts_of_a_small_table(spark):
    base = [f"w{i}" for i in range(300)]
    texts = {1: " ".join(base), 2: " ".join(base[:290] + ["x", "y"]), 3: " ".join(base[:150] + ["q"] * 150), 4: None, 5: "", 6: "a b",
             7: "a b", 8: "A  b", 9: " ".join(base[12:] + ["z"] * 5), 10: "one two three four five six"}
    docs = spark.createDataFrame([(k, v, "c") for k, v in texts.items()], "doc_id long, text string, n_shingles string")
    kept = simhash.keep_one(docs, similarity=0.8)
    # 4 and 5 are empty, 6 to 8 the same words, 2 and 9 near 1, 3 is not.
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6, 10]
    assert simhash.keep_one(docs.where("false"), similarity=0.8).count() == 0


def test_documents_end_to_end(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text + " end"), (1, "other words are here " * 9), (None, text), (2, None), (7, ""),
            (8, "tiny"), (4, "x" * 100000), (5, text)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    fps = simhash.fingerprints(docs.drop("fp"))
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.component_ids(fps).collect())
    items = [(k, brute_fingerprint(t)) for k, t in rows]
    assert got == sorted((str(k), c) for (k, _), c in zip(items, brute_components(items), strict=True))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_components(items)))
    empty = docs.where(F.lit(False))
    assert simhash.component_ids(simhash.fingerprints(empty.drop("fp"))).count() == 0
    assert simhash.keep_one(empty).count() == 0
