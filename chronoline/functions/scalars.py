"""Column expressions used inside the timeline and evaluation jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoline import fixed_values as fv

DAY = 1440


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from `start` to `end`, both cut to the minute."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", start), F.date_trunc("minute", end))


def minute_floor(ts: str | Column) -> Column:
    return F.date_trunc("minute", _c(ts)).cast("timestamp_ntz")


def age_parts(age: str | Column) -> dict[str, Column]:
    """Whole years, months, days, hours and minutes of an age in minutes."""
    a = _c(age)
    days = F.floor(a / DAY)
    rest = F.pmod(a, F.lit(DAY))
    return {
        "years": F.floor(days / 365),
        "months": F.floor(F.pmod(days, F.lit(365)) / 30),
        "days": F.pmod(F.pmod(days, F.lit(365)), F.lit(30)),
        "hours": F.floor(rest / 60),
        "minutes": F.pmod(rest, F.lit(60)),
    }


COMPONENT_SCALE = {"years": 120, "months": 12, "days": 29, "hours": 23, "minutes": 59}
COMPONENT_MINUTES = {"years": 365 * DAY, "months": 30 * DAY, "days": DAY, "hours": 60, "minutes": 1}


def age_components(age: str | Column) -> dict[str, Column]:
    """Age parts scaled to about 0..1."""
    return {k: v / F.lit(float(COMPONENT_SCALE[k])) for k, v in age_parts(age).items()}


def components_to_age(parts: dict[str, Column] | None = None) -> Column:
    """Minutes back from scaled parts."""
    parts = parts or {k: F.col(k) for k in COMPONENT_SCALE}
    terms = [F.round(parts[k] * COMPONENT_SCALE[k]).cast("long") * COMPONENT_MINUTES[k]
             for k in COMPONENT_SCALE]
    return reduce(lambda a, b: a + b, terms)


def section_bins(start: int, end: int, step: int) -> int:
    """Day bins of one section of the time bins; the last may reach beyond its end."""
    return (end - start) // step + 1


def n_time_bins(small: int, large: int, sections: Sequence = fv.TIME_BIN_SECTIONS) -> int:
    per_day = DAY // large
    return DAY // small + sum(section_bins(*section) * per_day for section in sections) + 1


def time_bin_label(previous: str | Column, new: str | Column, first: int | Column = 0,
                   small: int = 10, large: int = 60,
                   sections: Sequence = fv.TIME_BIN_SECTIONS) -> Column:
    """Label of the step from one age to the next."""
    prev, cur = _c(previous), _c(new)
    first_label = F.lit(first) if isinstance(first, int) else first
    diff = cur - prev
    calendar = F.floor(cur / DAY) - F.floor(prev / DAY)
    clock = F.floor(F.pmod(cur, F.lit(DAY)) / large)
    per_day = DAY // large
    expr = F.when(F.floor(diff / DAY) < 1, F.floor(F.pmod(diff, F.lit(DAY)) / small))
    offset = DAY // small
    for start, end, step in sections:
        within = offset + F.floor((calendar - start) / step) * per_day + clock
        expr = expr.when((calendar >= start) & (calendar <= end), within)
        offset += section_bins(start, end, step) * per_day
    return (first_label + expr.otherwise(F.lit(offset))).cast("int")


def age_text(age: str | Column) -> Column:
    p = age_parts(age)
    return F.concat(
        p["years"].cast("string"), F.lit("Y/"), p["months"].cast("string"), F.lit("M/"),
        p["days"].cast("string"), F.lit("D "),
        F.lpad(p["hours"].cast("string"), 2, "0"), F.lit(":"),
        F.lpad(p["minutes"].cast("string"), 2, "0"))


def parse_age_text(text: str | Column) -> Column:
    """Minutes from an age text; null when the text has another shape."""
    t = _c(text)

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(t, fv.AGE_TEXT_PATTERN, i), F.lit("")).try_cast("long")

    days = part(1) * 365 + part(2) * 30 + part(3)
    return days * DAY + part(4) * 60 + part(5)


def leading_number(text: str | Column) -> Column:
    found = F.regexp_extract(_c(text), fv.LEADING_NUMBER_PATTERN, 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def any_number(text: str | Column) -> Column:
    found = F.regexp_extract(_c(text), fv.ANY_NUMBER_PATTERN, 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def lab_value(code: str | Column, result: str | Column, target: str | Sequence[str],
              unit: str) -> Column:
    """Parsed number of a row of `target` whose result ends with `unit`, else null."""
    targets = [target] if isinstance(target, str) else list(target)
    return F.when(_c(code).isin(targets) & F.coalesce(_c(result), F.lit("")).endswith(unit),
                  leading_number(result))


def segment_code(code: str | Column, sizes: Sequence[int]) -> list[Column]:
    """Pieces of a code by position; earlier positions are shown as `*`."""
    c, out, start = _c(code), [], 0
    for size in sizes:
        piece = F.substring(c, start + 1, size)
        out.append(F.when(F.length(piece) > 0, F.concat(F.lit("*" * start), piece))
                   .otherwise(F.lit("")))
        start += size
    return out


def normalize_code(code: str | Column) -> Column:
    """Upper case letters and digits only; null becomes an empty string."""
    return F.coalesce(F.regexp_replace(F.upper(_c(code)), "[^A-Z0-9]", ""), F.lit(""))


def code_group(code: str | Column) -> Column:
    """Reporting group of a diagnosis: three characters, four for Z codes."""
    n = normalize_code(code)
    return F.when(n.startswith("Z"), F.substring(n, 1, 4)).otherwise(F.substring(n, 1, 3))


def has_prefix(code: str | Column, prefixes: Sequence[str]) -> Column:
    if not prefixes:
        return F.lit(False)
    c = _c(code)
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def normalize_sex(code: str | Column) -> Column:
    c = F.upper(F.trim(_c(code)))
    return F.when(c.isin("[M]", "M"), F.lit("male")).when(c.isin("[F]", "F"), F.lit("female"))


def map_literal(column: str | Column, mapping: dict) -> Column:
    """Value of a small fixed map, null when the key is absent."""
    c = _c(column)
    expr = None
    for key, value in mapping.items():
        expr = F.when(c == F.lit(key), F.lit(value)) if expr is None else \
            expr.when(c == F.lit(key), F.lit(value))
    return expr


def sex_token(sex: str | Column) -> Column:
    return map_literal(sex, fv.SEX_TOKENS)


def disposition_token(disposition: str | Column) -> Column:
    return map_literal(disposition, fv.DISPOSITION_TOKENS)


def token_description(token: str | Column) -> Column:
    return F.coalesce(map_literal(token, fv.TOKEN_DESCRIPTIONS), F.lit(""))


def logit_quantile(index: Column, bins: int, eps: float = fv.LOGIT_EPS) -> Column:
    """Quantile number `index` of a grid that is even in logit space."""
    low = math.log(eps / (1 - eps))
    step = -2 * low / (bins - 1)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(low) + index * F.lit(step))))


def uniform_step(index: Column, bins: int) -> Column:
    return index / F.lit(float(bins - 1))


def nearest_bin(value: str | Column, grid: str | Column) -> Column:
    """Zero-based index of the closest grid value, the smallest on ties."""
    v = _c(value)
    best = F.array_min(F.transform(
        _c(grid), lambda x, i: F.struct(F.abs(x - v).alias("d"), i.alias("i"))))
    return best["i"]


def bin_to_value(index: str | Column, grid: str | Column) -> Column:
    return F.round(F.try_element_at(_c(grid), (_c(index) + 1).cast("int")), 5)


def stable_digest(seed: int, *parts: str | Column) -> Column:
    """Hexadecimal digest of the seed and the key parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]))


def digest_uniform(digest: Column) -> Column:
    """Number in [0, 1) from the first 13 hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def digest_index(digest: Column, n: Column) -> Column:
    """Index in 0..n-1 from a digest."""
    return F.floor(digest_uniform(digest) * n).cast("long")


def stable_seed(seed: int, *parts: str | Column) -> Column:
    """28-bit seed from the digest of the key parts."""
    return F.conv(F.substring(stable_digest(seed, *parts), 1, 7), 16, 10).cast("long")


def real_trajectory_id(patient: str | Column, admission: str | Column) -> Column:
    return F.concat_ws("::", F.lit("real"), _c(patient), _c(admission).cast("string"))


def simulated_trajectory_id(patient: str | Column, admission: str | Column,
                            day: str | Column, simulation: str | Column) -> Column:
    return F.concat_ws("::", F.lit("simulation"), _c(patient), _c(admission).cast("string"),
                       F.concat(F.lit("day"), _c(day).cast("string")), _c(simulation))
