import random

from pyspark.sql import functions as F

from chronoline.llm import decontamination as dec


def shingles(text, size=5):
    words = (text or "").lower().replace("\n", " ").replace("\t", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(docs, items):
    out = []
    for item, text in items:
        if text is None:
            continue
        n = len([w for w in text.lower().split() if w])
        want = shingles(text, min(n, 5)) if n else set()
        for doc, body in docs:
            got = len(want & shingles(body, min(n, 5)))
            if want and 100 * got >= 80 * len(want):
                out.append((str(doc), item, len(want), got))
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 9, 14, 15, 24, 25, 60, 60))]
    items += [(90, None), (91, ""), (92, " \n"), (7, items[7][1]), (93, items[7][1])]
    docs = [(0, None), (1, ""), (None, items[8][1]), (2, "w1"), (3, "w1 " * 30000 + items[9][1].upper())]
    for k in range(120):
        words = say(r.randint(0, 60))
        for _ in range(r.randint(0, 2)):
            part = (r.choice(items[4:13])[1]).split()
            for _ in range(r.randint(0, 2)):
                part[r.randrange(len(part))] = "changed"
            at = r.randint(0, len(words))
            words[at:at] = part
        docs.append((10 + k, r.choice((" ", "\n", "  ")).join(words)))
    docs += docs[-3:]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, digest string")
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, sketch string")
    got = sorted((str(x.doc_id), x.item_id, x.n_shingles, x.n_shared) for x in dec.contained(frame, bench).collect())
    want = sorted(brute(docs, dict.fromkeys(items)))
    assert got == want and len(got) > 50
    kept = dec.decontaminate(frame, bench)
    bad = {d for d, *_ in want}
    assert kept.columns == frame.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(d) for d, _ in docs if str(d) not in bad)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    nothing = F.lit(False)
    assert dec.contained(docs, bench.where(nothing)).count() == 0 and dec.contained(docs.where(nothing), bench).count() == 0
    assert dec.contained(docs, bench).count() == 1
    assert dec.decontaminate(docs, bench.where(nothing)).count() == 1


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_ROWS", 0)
    test_empty_tables(spark)
