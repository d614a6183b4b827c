"""Bootstrap counts by a digest tree: exact multinomial weights, no row for a draw.

Cells (ids of one unit each, or condensed cells with a number of units) lie side by side
on a line of N units. All draws of a replicate stand at the root of a binary tree over the
line; each node sends a binomial share of its draws to its left child, by digests of
(seed, replicate, node). Shares are exact: a node of many draws compares the binary places
of its draws with those of the left part's share, and as every place is a fair coin, a place
of all draws is one count of digest bits. So a replicate costs about N / 60 digests a level,
and its weights add up to the number of draws on any layout and after any retry.

The upper levels split the line into pieces of at most `piece` units by arithmetic alone;
the draws of a replicate are cut into blocks there, whose counts add up. Below, the counts
of a piece meet its cells, and the splitting goes on between cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.functions import ordered as o
from chronoline.functions import scalars as c

PIECE = 4096
BLOCK = 1 << 22
FEW = 16
PLACES = 62
WORD = 60
STEP = 10


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _shift_right(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n.cast("int"))


def _label(*parts: Column) -> Column:
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def _heads(n: Column, label: Column) -> Column:
    """Heads among `n` fair coins: set bits of digests, 60 coins to a digest."""
    def word(w: Column) -> Column:
        bits = F.conv(F.substring(F.md5(_label(label, w)), 1, 15), 16, 10).cast("long")
        return F.bit_count(_shift_right(bits, WORD - F.least(n - w * WORD, _long(WORD))))
    last = F.floor((n + (WORD - 1)) / WORD).cast("long") - 1
    return F.aggregate(F.sequence(_long(0), last), _long(0), lambda s, w: s + word(w))


def binomial(n: Column, part: Column, whole: Column, label: Column) -> Column:
    """Draws out of `n` that fall into `part` of `whole` units (0 < part < whole < 2^62)."""
    def one(i: Column) -> Column:
        return F.when(c.digest_uniform(F.md5(_label(label, i))) * whole < part, 1).otherwise(0).cast("long")
    few = F.aggregate(F.sequence(_long(1), n), _long(0), lambda s, i: s + one(i))

    def place(s: Column, j: Column) -> Column:
        # Undecided draws share all places so far with the part's share; heads have a zero in this one.
        twice = s["rem"] * 2
        bit = twice >= whole
        split = _let(_heads(s["rest"], _label(label, j)), lambda h: F.struct(
            F.when(bit, s["rest"] - h).otherwise(h).alias("rest"),
            F.when(bit, twice - whole).otherwise(twice).alias("rem"),
            F.when(bit, s["won"] + h).otherwise(s["won"]).alias("won")))
        return F.when((s["rest"] == 0) | (s["rem"] == 0), s).otherwise(split)
    start = F.struct(n.alias("rest"), part.alias("rem"), _long(0).alias("won"))
    many = F.aggregate(F.sequence(F.lit(1), F.lit(PLACES)), start, place, lambda s: s["won"])
    return F.when(n == 0, _long(0)).when(n <= FEW, few).otherwise(many)


def levels_for(units: int, piece: int) -> int:
    """Halvings after which a part of the line has at most `piece` units."""
    levels = 0
    while -(-units >> levels) > piece:
        levels += 1
    return levels


def _upper(rows: DataFrame, units: int, first: int, last: int, seed: int) -> DataFrame:
    """(replicate, block, k, n) of level `first` split down to level `last`; empty parts go."""
    edge = lambda k, level: _shift_right(k * units, level)

    def split(node: Column, level: Column) -> Column:
        k, n = node["k"], node["n"]
        lo, mid, hi = edge(k, level), edge(k * 2 + 1, level + 1), edge(k + 1, level)
        share = binomial(n, mid - lo, hi - lo, _label(F.lit(seed), F.col("replicate"), F.col("block"), lo, hi))
        return _let(share, lambda left: F.array(
            F.struct((k * 2).alias("k"), left.alias("n")), F.struct((k * 2 + 1).alias("k"), (n - left).alias("n"))))

    def descend(nodes: Column, level: Column) -> Column:
        return F.filter(F.flatten(F.transform(nodes, lambda x: split(x, level))), lambda x: x["n"] > 0)
    nodes = F.aggregate(F.sequence(F.lit(first), F.lit(last - 1)), F.array(F.struct("k", "n")), descend)
    return rows.select("replicate", "block", F.explode(nodes).alias("__x")).select("replicate", "block", "__x.*")


def _piece_counts(cells: DataFrame, units: int, draws: int, levels: int, replicates: int, seed: int,
                  block: int) -> DataFrame:
    """(replicate, k, n): draws that fall into each piece of the line."""
    blocks = -(-draws // block)
    ids = cells.sparkSession.range(replicates * blocks)
    at = F.col("id") % blocks
    rows = ids.select(F.floor(F.col("id") / blocks).cast("long").alias("replicate"), at.alias("block"), _long(0).alias("k"),
                      F.least(_long(block), draws - at * block).cast("long").alias("n"))
    level = min(levels, STEP)
    if level:
        rows = _upper(rows, units, 0, level, seed)
    if blocks > 1:
        # The counts of all blocks meet in one node, which goes on under the label of the first.
        rows = rows.groupBy("replicate", "k").agg(F.sum("n").alias("n")).withColumn("block", _long(0))
    while level < levels:
        rows = _upper(rows, units, level, min(levels, level + STEP), seed)
        level = min(levels, level + STEP)
    return rows.select("replicate", "k", "n")


def _cells_by_piece(line: DataFrame, units: int, levels: int, names: Sequence[str]) -> DataFrame:
    """(k, cells): the parts of cells inside each piece, in order; at most `piece` of them."""
    of = lambda pos: F.floor(F.expr(f"((`{pos}` + 1) * {1 << levels}L - 1) div {units}L"))
    spread = line.withColumns({"__k0": of("__start"), "__last": F.col("__end") - 1}).withColumn("__k1", of("__last"))
    # A cell of very many pieces is dealt in two steps, so that no array grows with it.
    groups = F.sequence(F.floor(F.col("__k0") / PIECE), F.floor(F.col("__k1") / PIECE))
    spread = spread.withColumn("__g", F.explode(groups)).withColumn("k", F.explode(F.sequence(
        F.greatest(F.col("__k0"), F.col("__g") * PIECE), F.least(F.col("__k1"), F.col("__g") * PIECE + (PIECE - 1)))))
    edge = lambda k: _shift_right(k * units, F.lit(levels))
    part = F.struct(F.greatest("__start", edge(F.col("k"))).alias("lo"), F.least("__end", edge(F.col("k") + 1)).alias("hi"),
                    F.struct(*names).alias("cell"))
    by_place = lambda a, b: (a["lo"] - b["lo"]).cast("int")
    return spread.groupBy("k").agg(F.array_sort(F.collect_list(part), by_place).alias("cells"))


def multinomial_weights(cells: DataFrame, order: Column, replicates: int, units: str | None = None,
                        draws: int | None = None, seed: int = 0, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """(replicate, columns of `cells`, weight): draws with replacement, counted per cell.

    `units` names the number of units of a cell (null or below 1: none); without it each
    row is one unit. `draws` is the number of draws of a replicate, by default that of all
    units. `order` is a hexadecimal digest that sets the cells' places; the columns break its
    ties, so rows of `cells` must be distinct. Cells without a draw do not appear, an empty
    table gives an empty result.
    """
    names = cells.columns
    size = _long(1) if units is None else F.coalesce(F.col(units).cast("long"), _long(0))
    sized = cells.withColumns({"__d": order, "__u": size}).filter(F.col("__u") > 0)
    total, rows = sized.agg(F.coalesce(F.sum("__u"), _long(0)), F.count(F.lit(1))).first()
    draws = total if draws is None else draws
    if not total or not draws or not replicates:
        return cells.select(_long(0).alias("replicate"), *names, _long(0).alias("weight")).limit(0)
    levels = levels_for(total, piece)
    line = o.ordered_scan(sized, [], ["__d", *names], o.hash_segment("__d", o.digits_for(rows)), {
        "__end": o.running_sum(F.col("__u"))})
    line = line.withColumn("__start", F.col("__end") - F.col("__u"))
    counts = _piece_counts(cells, total, draws, levels, replicates, seed, block)
    met = counts.join(_cells_by_piece(line, total, levels, names), "k")

    lo = lambda i: F.get(F.col("cells"), i)["lo"]
    hi = lambda i: F.get(F.col("cells"), i - 1)["hi"]

    def split(x: Column) -> Column:
        i, j, n = x["i"], x["j"], x["n"]
        mid = F.floor((i + j) / 2).cast("int")
        share = binomial(n, lo(mid) - lo(i), hi(j) - lo(i), _label(F.lit(seed), F.col("replicate"), F.lit("c"), lo(i), hi(j)))
        halves = _let(share, lambda left: F.array(F.struct(i.alias("i"), mid.alias("j"), left.alias("n")),
                                                  F.struct(mid.alias("i"), j.alias("j"), (n - left).alias("n"))))
        return F.when(j - i == 1, F.array(x)).otherwise(halves)

    def descend(nodes: Column, _: Column) -> Column:
        return F.filter(F.flatten(F.transform(nodes, split)), lambda x: x["n"] > 0)
    root = F.array(F.struct(F.lit(0).alias("i"), F.size("cells").alias("j"), F.col("n")))
    depth = (piece - 1).bit_length()
    nodes = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, descend) if depth else root
    # The leaves of a piece are its drawn cells.
    drawn = met.select("replicate", F.explode(F.transform(nodes, lambda x: F.struct(
        F.get(F.col("cells"), x["i"])["cell"].alias("cell"), x["n"].alias("weight")))).alias("__x"))
    drawn = drawn.select("replicate", "__x.cell.*", F.col("__x.weight").alias("weight"))
    if units is None:
        return drawn
    return drawn.groupBy("replicate", *names).agg(F.sum("weight").alias("weight"))


def bootstrap_id_weights(ids: DataFrame, replicates: int, key: str = "patient_id", draws: int | None = None,
                         seed: int = 0, piece: int = PIECE) -> DataFrame:
    """(replicate, key, weight): patients drawn with replacement, each id one unit."""
    return multinomial_weights(ids.select(key).filter(F.col(key).isNotNull()).distinct(), c.stable_digest(seed, key),
                               replicates, draws=draws, seed=seed, piece=piece)


def bootstrap_probability_counts(counts: DataFrame, replicates: int, keys: Sequence[str] = (), seed: int = 0,
                                 piece: int = PIECE) -> DataFrame:
    """(replicate, keys, prob, n, pos): condensed (label, probability) rows drawn with replacement.

    `counts` is that of `metrics.probability_counts`; rows with equal keys, probability and
    label are one cell, so no row id is drawn and no replicate meets the rows.
    """
    cells = counts.select(*keys, "prob", F.explode(F.array(
        F.struct(F.lit(1).alias("label"), F.col("pos").cast("long").alias("units")),
        F.struct(F.lit(0).alias("label"), (F.col("n") - F.col("pos")).cast("long").alias("units")))).alias("__c")).select(
        *keys, "prob", "__c.*")
    place = c.stable_digest(seed, *keys, F.floor(F.col("prob") * 1e12).cast("long"), "label")
    drawn = multinomial_weights(cells, place, replicates, "units", seed=seed, piece=piece)
    return drawn.groupBy("replicate", *keys, "prob").agg(
        F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("pos"))
