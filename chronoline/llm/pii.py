"""Format-preserving pseudonyms for personal data in texts.

Personal values are found by one pattern, validated by their kind, and replaced by a
keyed permutation of the values of the same kind and format. Equal values get equal
pseudonyms in every document, different values different ones, and the key holder
can invert them. All kinds share one Feistel network over a vector of numbers, each
below its own radix: a round adds to each number of one half a hash (SHA-256 of key,
kind, radices, round, place and the other half) modulo its radix. What a kind keeps
fixed or derives anew makes the result valid again:

* card numbers (13 to 19 digits, Luhn): first digit kept, check digit derived;
* IBAN (mod 97), compact or in printed groups of four: country kept, check digits derived;
* dates (`2020-01-31`, `2020/01/31`, `31.01.2020`, `31/01/2020`): a day of the same 400
  years; `01/31/2020`, which is no day-first date, moves within such dates of days up
  to 28, else in its year only (29 February stays); dates with an English or German
  month name (`May 3, 1980`, `3 May 1980`, `3. Mai 1980`): as the first ones, "May" in
  the style of full names;
* IPv4 addresses (numbers up to 255); IPv6 addresses of eight groups, or shortened ones
  that begin with a group of three or four digits: hexadecimal digits, each group's
  length and leading zero kept; US social security numbers (valid ranges);
* telephone numbers: national ones, also ten digits in one, with valid first digits of
  area and exchange; with a country code, the code is kept; ten digits after +1 that are
  no national number keep which of area and exchange start with 0 or 1; in groups after
  a 0, the 0 is kept;
* e-mail addresses: letters and digits, but for the last label, by character class;
* secrets (keys with a known prefix, bearer tokens, values after password, token or the
  like, also as the end of a longer name or in quotes): by character class, long ones in
  pieces, so that the cost follows the length.

What fails its validation stays as it is. Only column expressions are used; texts
without a digit, `@`, `=` or `:` are passed through after one look (so a bare key without
any digit stays).

Defined cases: null stays null, empty stays empty; repeated rows and null ids are
treated alike; very long texts are whole; an empty table gives an empty result. Other
columns are kept. Values overlap never: the first pattern that fits at a place wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import let, table

ROUNDS = 8
KEY = "replace-this-key"
# The formats looked for, in order of precedence.
EMAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,8}\.[A-Za-z]{2,24}"
_KEYWORD = r"(?i:password|passwd|pwd|secret|token|api[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?:(?i:bearer)\s{1,3})?"
_PREFIX = r"gh[opsru]_|github_pat_|glpat-|sk-|xox[abprs]-"
_BEARER = r"(?i:bearer)\s{1,3}"
SECRET = (r"\bAKIA[0-9A-Z]{16}\b"
          rf"|\b(?:{_PREFIX})(?=[A-Za-z0-9_\-]{{0,200}}[0-9])[A-Za-z0-9_\-]{{16,}}+"
          rf"|\b{_BEARER}(?=[A-Za-z0-9_\-+/.=]{{0,200}}[0-9])[A-Za-z0-9_\-+/.=]{{16,}}+"
          r"|\beyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+"
          rf"|(?<![A-Za-z0-9]){_KEYWORD}[A-Za-z0-9_\-+/.]{{6,}}+")
SECRET_HEAD = rf"^(?:AKIA|{_PREFIX}|{_BEARER}|eyJ|{_KEYWORD})"
# Lengths of IBANs of countries whose numbers are printed in groups.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI NL", 19: "MK SI", 20: "AT BA EE KZ LT LU", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS",
                23: "AE GI IL", 24: "AD CZ ES PK RO SA SE SK TN", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM",
                28: "AL AZ CY DO HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT"}
IBAN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
IBAN_PRINTED = "|".join(
    rf"\b(?:{'|'.join(c.split())})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"\b"
    for n, c in IBAN_LENGTHS.items())
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
SHORT_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
GERMAN_MONTHS = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]
_ENGLISH = "|".join(MONTHS + SHORT_MONTHS)
TEXT_DATE = (rf"\b(?:{_ENGLISH}) [0-9]{{1,2}}, [0-9]{{4}}(?![0-9])"
             rf"|(?<![0-9.])[0-9]{{1,2}}\.? (?:{'|'.join(GERMAN_MONTHS)}|{_ENGLISH}) [0-9]{{4}}(?![0-9])")
DATE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{4}/[0-9]{2}/[0-9]{2}\b|\b[0-9]{2}\.[0-9]{2}\.[0-9]{4}\b|\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = (rf"(?<![0-9A-Za-z:._])(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:(?:{_HEX}:){{7}}{_HEX}"
        rf"|[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,5}}::{_HEX}(?::{_HEX}){{0,5}})(?![0-9A-Za-z:_])")
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
CARD = r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])"
# Digits of a telephone number with what may stand before each; a blank leads to no date and no IP address.
_DIGIT = rf"(?:(?! (?:{IPV4}|{DATE}))[ .\-])?\(?[0-9]\)?"
_TAIL = r"(?:[.\-]?\(?[0-9]\)?){0,6}(?![0-9])"
# After 8 digits (9 where numbers of 10 are written 3-3-2-2) a number is complete: no blank joins more digits to it.
PHONE = (rf"\+1(?:{_DIGIT}){{10}}(?![0-9])|\+[0-9]{{10,15}}(?![0-9])"
         rf"|\+(?:7|49|90)(?:{_DIGIT}){{2,9}}{_TAIL}|\+[0-9]{{1,3}}(?:{_DIGIT}){{2,8}}{_TAIL}"
         r"|(?<![0-9(])\(?[2-9][0-9]{2}\)?[ .\-][2-9][0-9]{2}[ .\-][0-9]{4}(?![0-9])"
         r"|(?<![0-9A-Za-z_.,/\-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9A-Za-z_/\-]|[.,][0-9])"
         r"|(?<![0-9A-Za-z_.,/+(\-])0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![0-9A-Za-z_/\-]|[.,][0-9])")
# Country codes of one and two digits; the others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IBAN, IBAN_PRINTED, TEXT_DATE, DATE, IPV6, IPV4, SSN, CARD, PHONE))
# Pieces of a long secret: 256 characters while 128 or more follow, and the rest.
PIECE = r".{256}(?=.{128})|.+"
DAYS_400_YEARS = 146_097  # 189 * 773


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + x)


def feistel(values: Column, radices: Column, kind: str, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of a vector of numbers, values[i] < radices[i], both arrays of long."""
    def split(v):
        half = F.ceil(F.size(v) / F.lit(2)).cast("int")
        return F.slice(v, F.lit(1), half), F.slice(v, half + 1, F.size(v))

    prefix = F.concat(F.lit(f"{key}|{kind}|"), F.array_join(radices.cast("array<string>"), ","))
    left_r, right_r = split(radices)

    def shifted(half, half_radices, other, i):
        told = F.concat_ws("|", prefix, i.cast("string"), F.array_join(other.cast("array<string>"), ","))
        return F.transform(F.arrays_zip(half.alias("v"), half_radices.alias("r")), lambda x, k: F.pmod(
            x["v"] + F.conv(F.substring(F.sha2(F.concat(told, F.lit("|"), k.cast("string")), 256), 1, 12), 16, 10).cast("long"),
            x["r"]))

    def turn(state, i):
        odd = i % 2 == 1
        return F.struct(F.when(odd, shifted(state["l"], left_r, state["r"], i)).otherwise(state["l"]).alias("l"),
                        F.when(odd, state["r"]).otherwise(shifted(state["r"], right_r, state["l"], i)).alias("r"))

    left, right = split(values)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(left.alias("l"), right.alias("r")), turn,
                       lambda s: F.concat(s["l"], s["r"]))


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _numbers(text: Column) -> Column:
    return _chars(text).cast("array<long>")


def _mapped(chars: Column, values: Column, char_of) -> Column:
    """`chars` with each letter or digit replaced by `char_of(char, next value)`."""
    def step(state, c):
        return F.when(c.rlike("[A-Za-z0-9]"), F.struct(
            F.concat(state["t"], char_of(c, F.get(values, state["n"]))).alias("t"), (state["n"] + 1).alias("n"))
        ).otherwise(F.struct(F.concat(state["t"], c).alias("t"), state["n"].alias("n")))
    return F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), step, lambda s: s["t"])


def _with_digits(text: Column, digits: Column) -> Column:
    """The text with its digits replaced in turn."""
    return _mapped(_chars(text), digits, lambda c, v: v.cast("string"))


def _digits_of(text: Column) -> Column:
    return _numbers(F.regexp_replace(text, "[^0-9]", ""))


def by_class(text: Column, kind: str, key: str) -> Column:
    """Digits, small and capital letters permuted within their class; all else stays."""
    low = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)
    members = F.filter(_chars(text), lambda c: c.rlike("[A-Za-z0-9]"))
    values = F.transform(members, lambda c: (F.ascii(c) - low(c)).cast("long"))
    radices = F.transform(members, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26).cast("long"))
    return let(feistel(values, radices, kind, key), lambda new: _mapped(
        _chars(text), new, lambda c, v: F.char(v + low(c))))


def _luhn(digits: Column) -> Column:
    """Luhn sum, the last digit in an undoubled place."""
    return _sum(F.transform(F.reverse(digits), lambda d, k: F.when(k % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))


def _card(text: Column, key: str) -> Column:
    def of(digits):
        body = F.slice(digits, F.lit(2), F.size(digits) - 2)
        moved = feistel(body, F.transform(body, lambda d: F.lit(10).cast("long")), "card", key)
        return let(F.concat(F.slice(digits, 1, 1), moved), lambda open_: F.when(
            _luhn(digits) % 10 == 0, _with_digits(text, F.concat(open_, F.array(
                F.pmod(-_luhn(F.array_append(open_, F.lit(0).cast("long"))), F.lit(10)).cast("long"))))).otherwise(text))
    return let(_digits_of(text), of)


def _iban_rest(text: Column) -> Column:
    """Number of an IBAN's characters, taken as ISO 13616 says, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55).cast("long")
    return F.aggregate(_chars(F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4))), F.lit(0).cast("long"),
                       lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _iban(text: Column, key: str) -> Column:
    country = F.substring(text, 1, 2)
    made = let(by_class(F.substring(text, 5, 40), "iban", key), lambda body: F.concat(
        country, F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body))
    return F.when(_iban_rest(text) == 1, made).otherwise(text)


def _iban_printed(text: Column, key: str) -> Column:
    return F.regexp_replace(_iban(F.replace(text, F.lit(" "), F.lit("")), key), "(.{4})(?=.)", "$1 ")


def _moved_day(day: Column, key: str) -> Column:
    """A day of the same 400 years."""
    number = F.datediff(day, F.lit("0001-01-01").cast("date")).cast("long")
    era, rest = F.floor(number / F.lit(DAYS_400_YEARS)), F.pmod(number, F.lit(DAYS_400_YEARS))
    moved = feistel(F.array(F.floor(rest / F.lit(773)), rest % 773), F.array(F.lit(189).cast("long"), F.lit(773).cast("long")),
                    "date", key)
    return let(moved, lambda v: F.date_add(F.lit("0001-01-01").cast("date"), (
        era * DAYS_400_YEARS + F.get(v, F.lit(0)) * 773 + F.get(v, F.lit(1))).cast("int")))


def _date(text: Column, key: str) -> Column:
    part = lambda at, n: F.substring(text, at, n)
    as_day = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("date")
    year_first = text.rlike("^[0-9]{4}")
    day = F.when(year_first, as_day(part(1, 4), part(6, 2), part(9, 2))).otherwise(as_day(part(7, 4), part(4, 2), part(1, 2)))
    mark = F.when(year_first, part(5, 1)).otherwise(part(3, 1))

    def written(new):
        y, m, d = (F.lpad(f(new).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.day, 2)))
        return F.when(year_first, F.concat(y, mark, m, mark, d)).otherwise(F.concat(d, mark, m, mark, y))

    # Month first: only where no day-first date stands there.
    year, month, dom = part(7, 4).cast("long"), part(1, 2).cast("long"), part(4, 2).cast("long")
    us = ~year_first & (part(3, 1) == "/") & as_day(part(7, 4), part(1, 2), part(4, 2)).isNotNull()
    era = year - F.pmod(year - 1, F.lit(400)) - 1
    long_ = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    whole = feistel(F.array(F.pmod(year - 1, F.lit(400)), month - 1, dom - 13), long_(400, 12, 16), "us-date", key)
    in_era = F.pmod(year - 1, F.lit(400))
    only_year = feistel(F.array(F.floor(in_era / F.lit(20)), in_era % 20), long_(20, 20), "us-date", key)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    moved_us = F.when(dom <= 28, let(whole, lambda v: F.concat_ws(
        "/", pad(F.get(v, F.lit(1)) + 1, 2), pad(F.get(v, F.lit(2)) + 13, 2), pad(era + 1 + F.get(v, F.lit(0)), 4)))
    ).when((month == 2) & (dom == 29), text).otherwise(let(only_year, lambda v: F.concat(
        part(1, 6), pad(era + 1 + 20 * F.get(v, F.lit(0)) + F.get(v, F.lit(1)), 4))))
    return let(day, lambda d: F.when(d.isNotNull(), written(_moved_day(d, key))).when(us, moved_us).otherwise(text))


def _text_date(text: Column, key: str) -> Column:
    month_first = text.rlike("^[A-Z]")
    dotted = text.rlike(r"^[0-9]+\.")
    name, day, year = F.regexp_extract(text, "([A-Za-zä]{3,})", 1), F.regexp_extract(text, "(?<![0-9])([0-9]{1,2})(?![0-9])", 1), F.right(text, F.lit(4))
    full, short, german = ([F.lit(m) for m in names] for names in (MONTHS, SHORT_MONTHS, GERMAN_MONTHS))
    full, short, german = F.array(*full), F.array(*short), F.array(*german)
    names = F.when(dotted & F.array_contains(german, name), german).when(F.array_contains(full, name), full).when(
        F.array_contains(short, name), short).otherwise(german)

    def of(names: Column) -> Column:
        date = F.try_to_timestamp(F.concat_ws("-", year, F.lpad(F.array_position(names, name).cast("string"), 2, "0"), F.lpad(day, 2, "0")),
                                  F.lit("yyyy-MM-dd")).cast("date")

        def written(new: Column) -> Column:
            d = F.when(day.startswith("0"), F.lpad(F.day(new).cast("string"), 2, "0")).otherwise(F.day(new).cast("string"))
            m, y = F.element_at(names, F.month(new)), F.lpad(F.year(new).cast("string"), 4, "0")
            return F.when(month_first, F.concat(m, F.lit(" "), d, F.lit(", "), y)).otherwise(
                F.concat(d, F.when(dotted, ".").otherwise(""), F.lit(" "), m, F.lit(" "), y))
        return let(date, lambda d: F.when(d.isNotNull(), let(_moved_day(d, key), written)).otherwise(text))
    return let(names, of)


def _ipv6(text: Column, key: str) -> Column:
    chars = _chars(text)
    is_hex = lambda c: c.rlike("[0-9A-Fa-f]")

    def told(c: Column, i: Column) -> Column:
        # A group's first digit stays zero or other than zero where more digits follow.
        lead = ((i == 0) | (F.get(chars, i - 1) == ":")) & F.coalesce(is_hex(F.get(chars, i + 1)), F.lit(False))
        v = F.conv(c, 16, 10).cast("long")
        least = F.when(lead & (v > 0), 1).otherwise(0).cast("long")
        return F.struct(c.alias("c"), (v - least).alias("v"), least.alias("least"),
                        F.when(lead, F.when(v > 0, 15).otherwise(1)).otherwise(16).cast("long").alias("r"))

    def of(digits: Column) -> Column:
        moved = feistel(F.transform(digits, lambda x: x["v"]), F.transform(digits, lambda x: x["r"]), "ipv6", key)
        small = F.zip_with(moved, digits, lambda v, x: F.lower(F.conv((v + x["least"]).cast("string"), 10, 16)))
        return let(_mapped(chars, small, lambda c, v: v), lambda new: F.when(text.rlike("[A-F]"), F.upper(new)).otherwise(new))
    return let(F.filter(F.transform(chars, told), lambda x: x["c"] != ":"), of)


def _ipv4(text: Column, key: str) -> Column:
    def of(octets):
        sound = (F.size(F.filter(octets, lambda x: x > 255)) == 0) & ~text.rlike(r"(^|\.)0[0-9]")
        moved = feistel(octets, F.transform(octets, lambda x: F.lit(256).cast("long")), "ipv4", key)
        return F.when(sound, F.array_join(moved.cast("array<string>"), ".")).otherwise(text)
    return let(F.split(text, r"\.").cast("array<long>"), of)


def _ssn(text: Column, key: str) -> Column:
    # Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
    area, group, serial = (F.substring(text, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    sound = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = feistel(F.array(place, group - 1, serial - 1),
                    F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)]), "ssn", key)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.when(sound, let(moved, lambda v: F.concat_ws(
        "-", pad(F.get(v, F.lit(0)) + F.when(F.get(v, F.lit(0)) >= 665, 2).otherwise(1), 3),
        pad(F.get(v, F.lit(1)) + 1, 2), pad(F.get(v, F.lit(2)) + 1, 4)))).otherwise(text)


def _phone(text: Column, key: str) -> Column:
    """Digits after the country code; of ten digits, the first of area and exchange stay 2 to 9, or 0 to 1 after +1."""
    coded = text.startswith("+")
    trunk = text.rlike("^0[0-9]{2,4} ")
    head = F.when(coded, F.regexp_extract(text, COUNTRY, 0)).when(trunk, "0").otherwise("")
    rest = F.substr(text, F.length(head) + 1)

    def of(digits):
        national = (F.size(digits) == 10) & ~trunk & (~coded | (head == "+1")) & (F.get(digits, F.lit(0)) > 1) & (F.get(digits, F.lit(3)) > 1)
        led = lambda k: national & k.isin(0, 3)
        # Numbers outside the national format must not land in it: their vectors have a kind of their own.
        moved = lambda kind, least: F.transform(feistel(
            F.transform(digits, lambda d, k: d - least(k)), F.transform(digits, lambda d, k: 10 - least(k)), kind, key),
            lambda v, k: v + least(k))
        # Of area and exchange one at least starts with 0 or 1: which of them do stays, so the set is closed.
        low = lambda d, k: k.isin(0, 3) & (d < 2)
        high = lambda d, k: k.isin(0, 3) & (d > 1)
        outside = F.zip_with(
            feistel(F.transform(digits, lambda d, k: F.when(high(d, k), d - 2).otherwise(d)),
                    F.transform(digits, lambda d, k: F.when(low(d, k), 2).when(high(d, k), 8).otherwise(10).cast("long")), "phone+1", key),
            F.transform(digits, lambda d, k: F.when(high(d, k), 2).otherwise(0).cast("long")), lambda v, least: v + least)
        two = lambda k: F.when(k.isin(0, 3), 2).otherwise(0).cast("long")
        none = lambda k: F.lit(0).cast("long")
        return F.when(national, F.concat(head, _with_digits(rest, moved("phone", two)))).when(
            (head == "+1") & (F.size(digits) == 10), F.concat(head, _with_digits(rest, outside))).when(
            coded & (head != "+1") & (F.size(digits) + F.length(head)).between(8, 16), F.concat(head, _with_digits(rest, moved("phone+", none)))
        ).when(trunk, F.concat(head, _with_digits(rest, moved("phone0", none)))
        ).otherwise(text)
    return let(_digits_of(rest), of)


def _email(text: Column, key: str) -> Column:
    return F.concat(by_class(F.regexp_extract(text, r"^(.*)\.[A-Za-z]+$", 1), "email", key),
                    F.regexp_extract(text, r"(\.[A-Za-z]+)$", 1))


def _secret(text: Column, key: str) -> Column:
    head = F.regexp_extract(text, SECRET_HEAD, 0)
    pieces = F.regexp_extract_all(F.substr(text, F.length(head) + 1), F.lit(PIECE), F.lit(0))
    return F.concat(head, F.array_join(F.transform(pieces, lambda p: by_class(p, "secret", key)), ""))


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of PATTERN."""
    is_ = lambda p: value.rlike(_whole(p))
    return (F.when(is_(EMAIL), _email(value, key)).when(is_(SECRET), _secret(value, key)).when(is_(IBAN), _iban(value, key))
            .when(is_(IBAN_PRINTED), _iban_printed(value, key)).when(is_(TEXT_DATE), _text_date(value, key))
            .when(is_(DATE), _date(value, key)).when(is_(IPV6), _ipv6(value, key)).when(is_(IPV4), _ipv4(value, key)).when(is_(SSN), _ssn(value, key))
            .when(is_(CARD), _card(value, key)).otherwise(_phone(value, key)))


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """(text, n_values): the text with its values replaced, and how many changed."""
    def of(found):
        def joined(new):
            # Between the matches stand one more parts than there are matches.
            parts = F.zip_with(F.split(text, PATTERN), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
            return F.struct(F.array_join(parts, "").alias("text"), changed.cast("long").alias("n_values"))
        return let(F.transform(found, lambda v: pseudonym(v, key)), joined)
    same = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_values"))
    return F.when(text.rlike("[0-9@=:]"), let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), of)).otherwise(same)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """`docs` with the text replaced, columns as they are; `count` names a column for the number of values."""
    done = docs.withColumn("__pii", pseudonymised(F.col(text), key)).withColumn(text, F.col("__pii.text"))
    done = done.withColumn(count, F.col("__pii.n_values")) if count else done
    return done.drop("__pii")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, count="n_values")
