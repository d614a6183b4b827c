"""The digest tree of bootstrap counts, restated in SQL."""

from __future__ import annotations

from collections.abc import Sequence

# Pieces small enough that both parts of the tree are used at the smallest scale.
TREE_PIECE = 64


def _bits(text: str, digits: int) -> str:
    return f"cast('0x' || substr(md5({text}), 1, {digits}) as bigint)"


def _binomial(n: str, part: str, whole: str, label: str) -> str:
    heads = f"""list_sum(list_transform(range(0, (s.rest + 59) // 60), lambda w:
 bit_count({_bits(f"{label} || '|' || x.j || '|' || w", 15)} >> (60 - least(s.rest - 60 * w, 60))::int)))::bigint"""
    step = f"""case when s.rest = 0 or s.rem = 0 then s when 2 * s.rem >= {whole}
 then {{'j': x.j, 'rest': s.rest - {heads}, 'rem': 2 * s.rem - {whole}, 'won': s.won + {heads}}} else {{'j': x.j, 'rest': {heads}, 'rem': 2 * s.rem, 'won': s.won}} end"""
    few = f"""list_sum(list_transform(range(1, {n} + 1), lambda i: case when {_bits(f"{label} || '|' || i", 13)}::double / 4503599627370496.0 * ({whole}) < {part} then 1 else 0 end))"""
    zero = "{'j': j, 'rest': 0::bigint, 'rem': 0::bigint, 'won': 0::bigint}"
    start = f"{{'j': 0::bigint, 'rest': ({n})::bigint, 'rem': ({part})::bigint, 'won': 0::bigint}}"
    many = f"list_reduce(list_transform(range(1, 63), lambda j: {zero}), lambda s, x: {step}, {start}).won"
    return f"(case when {n} = 0 then 0 when {n} <= 16 then {few} else {many} end)::bigint"


def tree_weights_sql(cells: str, names: Sequence[str], digest: str, replicates: int, piece: int,
                     units: str = "1") -> str:
    """(replicate, names, weight) of `cells`, a select of the named columns (and the units)."""
    cols = ", ".join(names)
    up_label = "'0|' || replicate || '|0|' || lo || '|' || hi"
    down_label = "'0|' || replicate || '|c|' || lo || '|' || hi"
    return f"""(with recursive tree_cells as materialized ({cells}),
tree_line as materialized (select *, (sum(u) over (order by d, {cols} rows unbounded preceding))::bigint as e from (select {cols}, {units} as u, {digest} as d from tree_cells) where u > 0),
tree_size as materialized (select *, (select min(l) from range(0, 40) t(l) where t_n <= {piece} * (1::bigint << l::int)) as levels from (select max(e) as t_n from tree_line)),
tree_up(replicate, k, lvl, n) as (
 select r, 0::bigint, 0, t_n from tree_size cross join range(0, {replicates}) t(r)
 union all
 select replicate, 2 * k + side, lvl + 1, case when side = 0 then share else n - share end from (
  select *, {_binomial("n", "(mid - lo)", "(hi - lo)", up_label)} as share from (
   select u.*, (k * t_n) >> lvl as lo, ((2 * k + 1) * t_n) >> (lvl + 1) as mid, ((k + 1) * t_n) >> lvl as hi
   from tree_up u cross join tree_size where lvl < levels and n > 0)) cross join range(0, 2) t(side)),
tree_parts as materialized (select *, row_number() over (partition by k order by lo) - 1 as place, count(*) over (partition by k) as m from (
 select {cols}, k, greatest(e - u, (k * t_n) >> levels::int) as lo, least(e, ((k + 1) * t_n) >> levels::int) as hi
 from tree_line join (select unnest(range(0, 1::bigint << levels::int)) as k, t_n, levels from tree_size) p on e > (k * t_n) >> levels::int and e - u < ((k + 1) * t_n) >> levels::int)),
tree_down(replicate, k, i, j, n) as (
 select replicate, u.k, 0::bigint, m, n from tree_up u join tree_size on lvl = levels join (select distinct k, m from tree_parts) p on p.k = u.k where n > 0
 union all
 select replicate, k, case when side = 0 then i else mid end, case when side = 0 then mid else j end, case when side = 0 then share else n - share end from (
  select *, {_binomial("n", "(middle - lo)", "(hi - lo)", down_label)} as share from (
   select t.replicate, t.k, t.i, t.j, t.n, (t.i + t.j) // 2 as mid, a.lo, b.lo as middle, c.hi from tree_down t
   join tree_parts a on a.k = t.k and a.place = t.i join tree_parts b on b.k = t.k and b.place = (t.i + t.j) // 2
   join tree_parts c on c.k = t.k and c.place = t.j - 1 where t.j - t.i > 1 and t.n > 0)) cross join range(0, 2) t(side))
select replicate, {cols}, sum(n)::bigint as weight from tree_down join tree_parts p using (k) where place = i and j - i = 1 and n > 0 group by replicate, {cols})"""
