"""Bootstrap counts by a digest tree, against a plain walk down the same tree."""

import hashlib
import math

from pyspark.sql import functions as F

from chronoline.functions import scalars as c
from chronoline.operators import multinomial as mn


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def binomial(n, part, whole, label):
    if n <= mn.FEW:
        return sum(int(md5(label, i)[:13], 16) / 16 ** 13 * whole < part for i in range(1, n + 1))
    won, rem = 0, part
    for j in range(1, mn.PLACES + 1):
        if not n or not rem:
            break
        heads = sum(((int(md5(label, j, w)[:15], 16)) >> (60 - min(60, n - 60 * w))).bit_count() for w in range(-(-n // 60)))
        rem *= 2
        if rem >= whole:
            won, n, rem = won + heads, n - heads, rem - whole
        else:
            n = heads
    return won


def weights(cells, replicates, seed, piece, draws=None):
    """cells: (name, units) in order of their places."""
    total = sum(u for _, u in cells)
    levels = mn.levels_for(total, piece)
    ends, at = [], 0
    for name, u in cells:
        ends.append((at, at + u, name))
        at += u
    out = {}

    def below(r, parts, n):
        if n and len(parts) == 1:
            out[r, parts[0][2]] = out.get((r, parts[0][2]), 0) + n
        elif n:
            m = len(parts) // 2
            left = binomial(n, parts[m][0] - parts[0][0], parts[-1][1] - parts[0][0], f"{seed}|{r}|c|{parts[0][0]}|{parts[-1][1]}")
            below(r, parts[:m], left)
            below(r, parts[m:], n - left)

    def above(r, k, level, n):
        lo, hi = (k * total) >> level, ((k + 1) * total) >> level
        if level == levels:
            return below(r, [(max(a, lo), min(b, hi), x) for a, b, x in ends if a < hi and b > lo], n)
        left = binomial(n, (((2 * k + 1) * total) >> (level + 1)) - lo, hi - lo, f"{seed}|{r}|0|{lo}|{hi}")
        above(r, 2 * k, level + 1, left)
        above(r, 2 * k + 1, level + 1, n - left)
    for r in range(replicates):
        above(r, 0, 0, total if draws is None else draws)
    return out


def test_weights_of_cells_follow_the_tree(rows):
    sized = [(f"c{i}", [1, 2, 7, 300, 0, None][i % 6]) for i in range(60)]
    cells = rows(sized, "name string, units long")
    places = sorted(((x, u) for x, u in sized if u), key=lambda x: (md5(3, x[0]), x[0]))
    for piece in (4, 64, 100_000):
        got = mn.multinomial_weights(cells, c.stable_digest(3, "name"), 3, "units", seed=3, piece=piece).collect()
        assert {(r["replicate"], r["name"]): r["weight"] for r in got} == weights(places, 3, 3, piece)
        assert len(got) == len({(r["replicate"], r["name"]) for r in got})


def test_weights_of_ids_on_any_layout(rows):
    ids = rows([(f"p{i}",) for i in range(500)] + [("p1",), (None,)], "patient_id string")
    places = sorted(((f"p{i}", 1) for i in range(500)), key=lambda x: (md5(0, x[0]), x[0]))
    one = mn.bootstrap_id_weights(ids, 4, piece=32)
    got = {(r["replicate"], r["patient_id"]): r["weight"] for r in one.collect()}
    assert got == weights(places, 4, 0, 32)
    assert all(sum(w for (r, _), w in got.items() if r == k) == 500 for k in range(4))
    again = mn.bootstrap_id_weights(ids.repartition(7), 4, piece=32)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, again.collect()))
    fewer = mn.bootstrap_id_weights(ids, 2, draws=40, piece=32).groupBy("replicate").agg(F.sum("weight").alias("n"))
    assert [r["n"] for r in fewer.collect()] == [40, 40]


def test_blocks_add_up(rows):
    cells = rows([("a", 100_000), ("b", 300_000), ("c", 1)], "name string, units long")
    got = mn.multinomial_weights(cells, c.stable_digest(0, "name"), 5, "units", piece=1000, block=30_000).collect()
    for k in range(5):
        own = {r["name"]: r["weight"] for r in got if r["replicate"] == k}
        assert sum(own.values()) == 400_001 and abs(own["a"] - 100_000) < 6 * math.sqrt(75_000)


def test_shares_are_binomial(rows):
    """Mean and variance of 4,000 shares, by few draws and by binary places."""
    for n in (12, 200):
        got = rows([(i,) for i in range(4000)], "i long").select(mn.binomial(
            F.lit(n).cast("long"), F.lit(3).cast("long"), F.lit(10).cast("long"), F.concat(F.lit("t|"), F.col("i"))).alias("x"))
        mean, var = got.agg(F.mean("x"), F.variance("x")).first()
        assert abs(mean - 0.3 * n) < 5 * math.sqrt(0.21 * n / 4000) and abs(var / (0.21 * n) - 1) < 0.12


def test_no_cells_no_draws(rows):
    none = rows([], "patient_id string")
    out = mn.bootstrap_id_weights(none, 3)
    assert out.columns == ["replicate", "patient_id", "weight"] and out.count() == 0
    ids = rows([("a",), ("b",)], "patient_id string")
    assert mn.bootstrap_id_weights(ids, 3, draws=0).count() == 0
    alone = mn.bootstrap_id_weights(rows([("a",)], "patient_id string"), 2).collect()
    assert sorted(map(tuple, alone)) == [(0, "a", 1), (1, "a", 1)]
