"""Ordered scans over long groups.

A plain window partitioned by patient puts every row of a patient in one task.
Here each group is cut into pieces by a monotone `segment` of its sort key;
rows are scanned inside their piece, each piece is condensed to one row, the
condensed rows (few per group) are scanned across pieces, and the carried
values are joined back on (group, piece). Results equal the plain window.

Without a segment the groups stay whole: that is for tables whose largest group is
known to be small, such as the patient blocks of `sources.blocks`, where a window by
patient needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEG = "__seg"
_KEY = "__key"


class Scan:
    """One output column of an ordered scan; build with the functions below."""

    def __init__(self, kind: str, value: Column | None = None, inclusive: bool = False):
        self.kind = kind
        self.value = value
        self.inclusive = inclusive


def row_number() -> Scan:
    """1-based position in the group."""
    return Scan("row_number")


def running_sum(value: Column) -> Scan:
    """Sum from the first row up to and including the current row."""
    return Scan("sum", value)


def last_before(value: Column, inclusive: bool = False) -> Scan:
    """Latest non-null value before the current row."""
    return Scan("last", value, inclusive)


def first_after(value: Column, inclusive: bool = False) -> Scan:
    """Next non-null value after the current row."""
    return Scan("first", value, inclusive)


def lag(value: Column) -> Scan:
    """Value of the previous row, null or not."""
    return Scan("lag", value)


def lead(value: Column) -> Scan:
    """Value of the next row, null or not."""
    return Scan("lead", value)


def total(aggregate: str, value: Column) -> Scan:
    """`sum`, `min` or `max` over the whole group, on every row."""
    return Scan(f"total_{aggregate}", value)


def _asc(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    outputs: dict[str, Scan],
) -> DataFrame:
    """Add the `outputs` columns to `df`.

    `segment` must be a function of the leading order column that never falls
    as that column rises, or None for groups that are small as a whole. `order` is ascending and must be total in a group.
    An empty `keys` ranks the whole table. Null keys form a group of their own
    and null order values come first: group and piece are structs, which are
    never null themselves and compare null fields as equal.
    """
    if segment is None:
        return _whole_scan(df, keys, order, outputs)
    base = df.withColumns({_KEY: F.struct(*keys) if keys else F.struct(F.lit(0)), _SEG: F.struct(segment)})
    inner = [_KEY, _SEG]
    wl = Window.partitionBy(*inner).orderBy(*_asc(order))
    before = wl.rowsBetween(Window.unboundedPreceding, -1)
    upto = wl.rowsBetween(Window.unboundedPreceding, 0)
    after = wl.rowsBetween(1, Window.unboundedFollowing)
    onward = wl.rowsBetween(0, Window.unboundedFollowing)

    local: dict[str, Column] = {}
    piece: list[Column] = []
    ordinal = _order_struct(order)
    for name, scan in outputs.items():
        loc, carry = f"__l_{name}", f"__p_{name}"
        if scan.kind == "row_number":
            local[loc] = F.row_number().over(wl)
            piece.append(F.count(F.lit(1)).alias(carry))
        elif scan.kind == "sum":
            local[loc] = F.sum(scan.value).over(upto)
            piece.append(F.sum(scan.value).alias(carry))
        elif scan.kind == "last":
            local[loc] = F.last(scan.value, True).over(upto if scan.inclusive else before)
            seen = F.when(scan.value.isNotNull(), ordinal)
            piece.append(F.max_by(scan.value, seen).alias(carry))
        elif scan.kind == "first":
            local[loc] = F.first(scan.value, True).over(onward if scan.inclusive else after)
            seen = F.when(scan.value.isNotNull(), ordinal)
            piece.append(F.min_by(scan.value, seen).alias(carry))
        elif scan.kind == "lag":
            local[loc] = F.lag(F.struct(scan.value.alias("v"))).over(wl)
            piece.append(F.max_by(F.struct(scan.value.alias("v")), ordinal).alias(carry))
        elif scan.kind == "lead":
            local[loc] = F.lead(F.struct(scan.value.alias("v"))).over(wl)
            piece.append(F.min_by(F.struct(scan.value.alias("v")), ordinal).alias(carry))
        elif scan.kind.startswith("total_"):
            agg = getattr(F, scan.kind.removeprefix("total_"))
            piece.append(agg(scan.value).alias(carry))
        else:
            raise ValueError(scan.kind)

    wp = Window.partitionBy(_KEY).orderBy(_SEG)
    p_before = wp.rowsBetween(Window.unboundedPreceding, -1)
    p_after = wp.rowsBetween(1, Window.unboundedFollowing)
    p_all = Window.partitionBy(_KEY)
    carried: dict[str, Column] = {}
    for name, scan in outputs.items():
        col = F.col(f"__p_{name}")
        if scan.kind in ("row_number", "sum"):
            carried[f"__c_{name}"] = F.sum(col).over(p_before)
        elif scan.kind in ("last", "lag"):
            carried[f"__c_{name}"] = F.last(col, True).over(p_before)
        elif scan.kind in ("first", "lead"):
            carried[f"__c_{name}"] = F.first(col, True).over(p_after)
        else:
            agg = getattr(F, scan.kind.removeprefix("total_"))
            carried[f"__c_{name}"] = agg(col).over(p_all)

    renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(inner)]
    pieces = (
        base.groupBy(*inner).agg(*piece)
        .select(*renamed, *[expr.alias(n) for n, expr in carried.items()])
    )
    scanned = base.select("*", *[expr.alias(n) for n, expr in local.items()])
    # plain equality: the window's partitioning and sort serve the join as they are
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(inner)])
    joined = scanned.join(pieces, on, "left")

    result = []
    for name, scan in outputs.items():
        loc, car = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if scan.kind == "row_number":
            value = loc.cast("long") + F.coalesce(car, F.lit(0))
        elif scan.kind == "sum":
            value = F.coalesce(loc, F.when(car.isNotNull(), F.lit(0))) + F.coalesce(car, F.lit(0))
        elif scan.kind in ("last", "first"):
            value = F.coalesce(loc, car)
        elif scan.kind in ("lag", "lead"):
            value = F.coalesce(loc, car)["v"]
        else:
            value = car
        result.append(value.alias(name))
    kept = [c for c in df.columns if c not in outputs]
    return joined.select(*kept, *result)


def _whole_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], outputs: dict[str, Scan]) -> DataFrame:
    """The same outputs by plain windows over whole groups."""
    group = Window.partitionBy(*keys)
    w = group.orderBy(*_asc(order))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    values: dict[str, Column] = {}
    for name, scan in outputs.items():
        if scan.kind == "row_number":
            values[name] = F.row_number().over(w).cast("long")
        elif scan.kind == "sum":
            values[name] = F.sum(scan.value).over(upto)
        elif scan.kind == "last":
            values[name] = F.last(scan.value, True).over(upto if scan.inclusive else before)
        elif scan.kind == "first":
            values[name] = F.first(scan.value, True).over(onward if scan.inclusive else after)
        elif scan.kind == "lag":
            values[name] = F.lag(scan.value).over(w)
        elif scan.kind == "lead":
            values[name] = F.lead(scan.value).over(w)
        elif scan.kind.startswith("total_"):
            values[name] = getattr(F, scan.kind.removeprefix("total_"))(scan.value).over(group)
        else:
            raise ValueError(scan.kind)
    return df.select(*[c for c in df.columns if c not in outputs], *[v.alias(n) for n, v in values.items()])


def global_row_number(df: DataFrame, group: str, order: Sequence[str], segment: Column,
                      out: str = "position", letters: int = 3) -> DataFrame:
    """Position of each row of the whole table by group name and `order`.

    Rows are numbered inside their group, and the groups' sizes, one row per
    group, are summed over pieces of the group's name, so no task sees more
    than a piece of either.
    """
    inside = ordered_scan(df, [group], order, segment, {"__n": row_number()})
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    ends = ordered_scan(sizes, [], [group], F.substring(group, 1, letters), {"__end": running_sum(F.col("__size"))})
    starts = ends.select(F.struct(group).alias("__g"), (F.col("__end") - F.col("__size")).alias("__start"))
    return (inside.withColumn("__g", F.struct(group)).join(starts, "__g")
            .withColumn(out, F.col("__n") + F.col("__start")).drop("__g", "__n", "__start"))


def time_segment(age: str | Column, minutes: int | None) -> Column | None:
    """Piece of a minute-valued sort key; without a width, none."""
    if minutes is None:
        return None
    col = F.col(age) if isinstance(age, str) else age
    return F.floor(col / F.lit(minutes))


def number_segment(value: str | Column) -> Column:
    """Piece of a double: 64 pieces per power of two, rising with the value."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    mag = F.greatest(F.abs(v), F.lit(1e-300))
    exp = F.floor(F.log2(mag))
    frac = F.floor((mag / F.pow(F.lit(2.0), exp) - 1.0) * 64.0)
    piece = exp * 64 + F.greatest(F.lit(0), F.least(F.lit(63), frac)) + 70_000
    return (F.when(v > 0, piece).when(v < 0, -piece).otherwise(F.lit(0))).cast("long")


def digits_for(rows: int, piece: int = 100_000) -> int:
    """Digits of a digest that cut so many rows into pieces of at most about `piece` rows."""
    digits = 1
    while 16 ** digits * piece < rows:
        digits += 1
    return digits


def hash_segment(text: str | Column, digits: int = 3) -> Column:
    """Piece of a hexadecimal digest: its first digits."""
    col = F.col(text) if isinstance(text, str) else text
    return F.substring(col, 1, digits)
