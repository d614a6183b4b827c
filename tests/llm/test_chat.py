import random

from pyspark.sql import functions as F

from chronoline.llm import chat


def brute(rows):
    convs = {}
    for conv, turn, role, text in dict.fromkeys(rows):
        convs.setdefault(conv, {}).setdefault(turn, []).append((role, text))
    order = lambda t: (t is not None, t or 0)
    key = lambda x: tuple((v is not None, v or "") for v in x)
    seq = {c: tuple((t, tuple(sorted(x[t], key=key))) for t in sorted(x, key=order)) for c, x in convs.items()}
    keep = []
    for c, s in seq.items():
        inside = any(len(o) > len(s) and o[:len(s)] == s for o in seq.values())
        equal = min((o for o, x in seq.items() if x == s), key=lambda o: (o is not None, o or 0))
        if not inside and equal == c:
            keep.append(c)
    return {c: "".join(f"<|{role or ''}|>\n{text or ''}\n<|end|>\n" for _, x in seq[c] for role, text in x) for c in keep}


def log(seed, n=80):
    r = random.Random(seed)
    rows = []
    bases = [[(k, r.choice(("user", "assistant", None)), r.choice(("a", "b", "", None))) for k in range(9)] for _ in range(4)]
    for conv in range(n):
        base = r.choice(bases)[:r.randint(1, 9)]
        if r.random() < 0.3:
            base = base[:-1] + [(base[-1][0] + r.choice((0, 3)), "user", f"own{r.randint(0, 5)}")]
        rows += [(conv, *t) for t in base]
    rows += [(None, 0, "user", "hi"), (None, None, "system", "x"), (500, None, "system", "x"), (501, 0, "user", "hi")]
    return rows + rows[:7] + [(7, 1, "user", "second row of a turn")]


def test_against_brute_force(spark):
    for segment in (2, 1024):
        rows = log(segment)
        frame = spark.createDataFrame([(*x, "clash", 3) for x in rows],
                                      "conv_id long, turn long, role string, text string, conv string, seg int").repartition(3)
        got = {}
        for x in chat.format_chats(frame, segment).orderBy("conv_id", "part").collect():
            got[x.conv_id] = got.get(x.conv_id, "") + x.text
        assert got == brute(rows)


def test_long_conversation_in_parts(spark):
    frame = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                     F.col("id").cast("string").alias("text"))
    short = frame.where("turn < 3000").withColumn("conv_id", F.lit(2).cast("long"))
    got = chat.format_chats(frame.union(short)).orderBy("part").collect()
    assert [(x.conv_id, x.part, x.n_turns) for x in got] == [(1, 0, 1024), (1, 1, 1024), (1, 2, 1024), (1, 3, 1024), (1, 4, 904)]


def test_empty_table(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
