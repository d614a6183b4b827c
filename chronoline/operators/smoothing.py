"""Local linear smoothing by prefix moments.

The fit at a grid point x weighs the values within its bandwidth r by the tricube
(1 - |d / r|^3)^3, d = value - x. On either side of x that is a polynomial in d, so the
weighted sums of the fit are combinations of the moments sum(d^k), k = 0 .. 11, of the
values between two bounds, and moments of a range come from running sums.

Bandwidth: the nearest k values of x are k neighbours in sorted order. Each value starts
one such stretch, whose end is found by rank; of the stretches whose middle lies below x
the last, and of those above it the first, reach least far from x. So r is two look-ups.

Moments: the axis is cut into cells of a power of two between r/4 and r/2, so a window
covers at most about ten cells whatever the number of values, and moments about a cell's
centre stay well conditioned when they are moved to x. Grid points of one cell width
share the cells. A window is cells in full plus running sums inside the cells of its two
bounds and of x.

Rows: values x cell widths in use (a handful), and about twenty for each grid point. The
tricube is exact here also below 0.001 r, where the usual implementation sets the weight
to 1; the difference of a weight is under 3e-9.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.functions import ordered as o

DEGREE = 11
FINEST = 45
RANK_PIECE = 65_536
# (1 - u^3)^3 in powers 0, 3, 6, 9 of u; below the grid point d = -u r.
TRICUBE = {1: (1, -3, 3, -1), -1: (1, 3, 3, 1)}
_NAMES = [*(f"m{k}" for k in range(DEGREE + 1)), *(f"y{k}" for k in range(DEGREE))]


def _piece(at: str, few_values: bool) -> Column | None:
    """Sorted values are scanned piece by piece, or as a whole where a key is known to have few of them."""
    return None if few_values else o.number_segment(at)


def bandwidths(counts: DataFrame, grid: DataFrame, keys: Sequence[str], frac: float, few_values: bool = False) -> DataFrame:
    """`grid` (keys, g, x) with r: the distance of the nearest `frac` of the rows of (keys, prob, n)."""
    keys = list(keys)
    values = o.ordered_scan(counts.select(*keys, "prob", F.col("n").cast("long").alias("n")), keys, ["prob"],
                            _piece("prob", few_values), {"upto": o.running_sum(F.col("n"))})
    sizes = values.groupBy(*keys).agg(F.sum("n").alias("total"))
    nearest = F.greatest(F.floor(F.lit(frac) * F.col("total") + F.lit(1e-10)), F.lit(1))
    none = F.lit(None).cast("double")
    asked = values.join(sizes, keys).withColumn("rank", F.col("upto") - F.col("n") + nearest).filter(F.col("rank") <= F.col("total"))
    ranked = values.select(*keys, F.col("upto").alias("rank"), F.lit(1).alias("kind"), F.col("prob").alias("at"), none.alias("start")).unionByName(
        asked.select(*keys, "rank", F.lit(0).alias("kind"), none.alias("at"), F.col("prob").alias("start")))
    stretches = o.ordered_scan(ranked, keys, ["rank", "kind"], None if few_values else F.floor(F.col("rank") / RANK_PIECE),
                               {"end": o.first_after(F.col("at"))}).filter("kind = 0")
    merged = stretches.select(*keys, ((F.col("start") + F.col("end")) / 2).alias("at"), "start", "end", F.lit(None).cast("int").alias("g")
                              ).unionByName(grid.select(*keys, F.col("x").alias("at"), none.alias("start"), none.alias("end"), "g"))
    # Nulls come first: at a tie the grid point precedes the stretch, which reaches equally far both ways.
    found = o.ordered_scan(merged, keys, ["at", "start", "g"], _piece("at", few_values),
                           {"__below": o.last_before(F.col("start")), "__above": o.first_after(F.col("end"))})
    return found.filter(F.col("g").isNotNull()).select(
        *keys, "g", F.col("at").alias("x"), F.least(F.col("__above") - F.col("at"), F.col("at") - F.col("__below")).alias("r"))


def _cell(at: Column) -> Column:
    return F.floor(at * F.pow(F.lit(2.0), F.col("level")))


def _centre() -> Column:
    return (F.col("cell") + 0.5) / F.pow(F.lit(2.0), F.col("level"))


def _moments() -> list[Column]:
    """Powers of the distance `e` from the cell's centre, weighted by rows (m0 ..) and positive rows (y0 ..)."""
    return [F.expr(f"{'n' if name[0] == 'm' else 'pos'} * pow(e, {name[1:]}D)").alias(name) for name in _NAMES]


def window_terms(counts: DataFrame, near: DataFrame, keys: Sequence[str], few_values: bool = False) -> DataFrame:
    """(keys, g, x, r, side, sign, level, cell, moments about the cell's centre): what adds up to each half window."""
    keys = list(keys)
    level = F.when(F.col("r") > 0, F.least(F.greatest(F.floor(-F.log2("r")) + 2, F.lit(0)), F.lit(FINEST))).otherwise(F.lit(FINEST))
    near = near.withColumn("level", level.cast("int")).withColumns(
        {"lo": F.col("x") - 0.999 * F.col("r"), "hi": F.col("x") + 0.999 * F.col("r")})
    used = near.select(*keys, "level").distinct()
    values = counts.select(*keys, "prob", F.col("n").cast("double").alias("n"), F.col("pos").cast("double").alias("pos")).join(
        used, keys).withColumn("cell", _cell(F.col("prob")))
    values = values.withColumn("e", F.col("prob") - _centre()).select(*keys, "level", "cell", "prob", *_moments())
    cells = values.groupBy(*keys, "level", "cell").agg(*[F.sum(n).alias(n) for n in _NAMES])
    # Whole cells between the bounds, and running sums up to each bound (below `lo`, up to `x` and `hi`).
    spans = F.array(*[F.struct(F.lit(s).alias("side"), a.alias("a"), b.alias("b")) for s, a, b in (
        (-1, _cell(F.col("lo")), _cell(F.col("x"))), (1, _cell(F.col("x")), _cell(F.col("hi"))))])
    point = [*keys, "g", "x", "r"]
    between = near.select(*point, "level", F.explode(spans).alias("s")).filter("s.a < s.b").select(
        *point, "level", F.col("s.side").alias("side"), F.lit(1).alias("sign"), F.explode(F.sequence("s.a", F.col("s.b") - 1)).alias("cell")
    ).join(cells, [*keys, "level", "cell"])
    bounds = F.array(*[F.struct(F.col(c).alias("at"), F.lit(kind).alias("kind"), F.lit(c).alias("bound"))
                       for c, kind in (("lo", 0), ("x", 2), ("hi", 2))])
    asked = near.select(*point, "level", F.explode(bounds).alias("b")).select(*point, "level", "b.*").withColumn("cell", _cell(F.col("at")))
    own = ["g", "x", "r", "bound"]
    # In a cell the values that a bound counts stand before it.
    rows = values.withColumnRenamed("prob", "at").withColumn("kind", F.lit(1)).unionByName(
        asked.select("*", *[F.lit(0.0).alias(n) for n in _NAMES]), allowMissingColumns=True)
    summed = o.ordered_scan(rows, [*keys, "level", "cell"], ["at", "kind", "g", "bound"], _piece("at", few_values),
                            {n: o.running_sum(F.col(n)) for n in _NAMES}).filter(F.col("bound").isNotNull())
    signs = F.when(F.col("bound") == "lo", F.array(F.struct(F.lit(-1).alias("side"), F.lit(-1).alias("sign")))).when(
        F.col("bound") == "hi", F.array(F.struct(F.lit(1).alias("side"), F.lit(1).alias("sign")))).otherwise(
        F.array(F.struct(F.lit(-1).alias("side"), F.lit(1).alias("sign")), F.struct(F.lit(1).alias("side"), F.lit(-1).alias("sign"))))
    edges = summed.select(*keys, *own[:3], "level", "cell", *_NAMES, F.explode(signs).alias("s")).select(
        *point, "level", "cell", *_NAMES, "s.*")
    return between.unionByName(edges)


def _moved(name: str) -> Column:
    """sum(d^k), in bandwidths, from scaled moments about a centre that is `shift` bandwidths off the grid point."""
    letter, k = name[0], int(name[1:])
    text = f"{letter}0"
    for j in range(1, k + 1):
        text = f"({text}) * shift + {letter}{j} * {math.comb(k, j)}D"
    return F.expr(text).alias(name)


def local_sums(terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, g, x, r, sw, sx, sy, sxx, sxy): tricube-weighted sums of 1, d, y, d^2 and d y.

    A point whose k-th nearest row is nearer than any other value has an empty window and
    no row. Counts are whole numbers, so that is decided exactly.
    """
    unit = F.when(F.col("r") > 0, F.col("r")).otherwise(F.lit(1.0))
    point = [*keys, "g", "x", "r"]
    scaled = terms.withColumn("unit", unit).select(
        *point, "side", "sign", "unit", ((_centre() - F.col("x")) / F.col("unit")).alias("shift"),
        *[F.expr(f"sign * {n} / pow(unit, {n[1:]}D)").alias(n) for n in _NAMES])
    # Terms of one half window add up before they are weighted.
    moved = scaled.select(*point, "side", "unit", *[_moved(n) for n in _NAMES]).groupBy(*point, "side", "unit").agg(
        *[F.sum(n).alias(n) for n in _NAMES])

    def weighted(letter: str, power: int) -> Column:
        def one(side: int) -> Column:
            a, b, c, d = (F.col(f"{letter}{3 * i + power}") * w for i, w in enumerate(TRICUBE[side]))
            return a + b + c + d
        # With no bandwidth only the values at x itself count, at distance 0.
        alone = F.col(f"{letter}0") if power == 0 else F.lit(0.0)
        value = F.when(F.col("r") <= 0, alone).when(F.col("side") > 0, one(1)).otherwise(one(-1))
        return F.sum(value * F.pow("unit", F.lit(float(power))))

    sums = {"sw": ("m", 0), "sx": ("m", 1), "sy": ("y", 0), "sxx": ("m", 2), "sxy": ("y", 1)}
    return moved.groupBy(*point).agg(F.sum("m0").alias("held"), *[weighted(*v).alias(n) for n, v in sums.items()]).filter(
        "held > 0").drop("held")


def lowess(counts: DataFrame, grid: DataFrame, keys: Sequence[str], frac: float, few_values: bool = False) -> DataFrame:
    """(keys, g, x, smooth) of (keys, prob, n, pos) at the points (keys, g, x, range).

    As good as flat, and so the mean, where the local spread is under a thousandth of `range`.
    """
    keys = list(keys)
    near = bandwidths(counts, grid, keys, frac, few_values)
    sums = local_sums(window_terms(counts, near, keys, few_values), keys)
    mean_x, mean_y = F.col("sx") / F.col("sw"), F.col("sy") / F.col("sw")
    var = F.col("sxx") / F.col("sw") - mean_x * mean_x
    cov = F.col("sxy") / F.col("sw") - mean_x * mean_y
    flat = F.sqrt(F.greatest(var, F.lit(0.0))) <= 0.001 * F.col("range")
    return sums.join(grid.select(*keys, "g", "range"), [*keys, "g"]).select(
        *keys, "g", "x", F.when(flat, mean_y).otherwise(mean_y - cov / var * mean_x).alias("smooth"))
