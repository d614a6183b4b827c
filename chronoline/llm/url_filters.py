"""URL filters: pattern rules indexed by their rarest literal token.

A rule is compiled into one regular expression and the literal tokens
(`[a-z0-9]+`) that any URL it fits must hold as whole tokens. Each rule is filed
under that one of its tokens which the fewest URLs of the input hold. A URL
fetches the rules filed under its own tokens, and only those run their regular
expression. Rules without a whole literal token are filed under the empty token,
which every URL holds.

Two kinds of rules share the index:

* site rules `host/path` fit the host and all its subdomains if the URL's path
  starts with the rule's; of several the longest wins (ties: block, then the
  alphabetically first);
* pattern rules: `*` any run, `^` one character that is no letter or digit, or
  the end, `|` start or end, `||` the start of the host or of one of its labels,
  all else literal, compared with the lower-cased URL. An allow pattern wins over
  block patterns. They decide where no site rule fits; without any, `allow`.

Only distinct URLs are judged, so a URL that fills a third of the table costs
one row; verdicts join back on the URL. The rule index is a plain join side:
Spark broadcasts it below its measured size limit and shuffles beyond.

Defined cases: a null URL, or one without `://`, has empty host and path, no site
rule, and `allow` unless a pattern fits (none fits null). Repeated rows and null
ids are judged each. Other columns of the input are not touched or returned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import LOWER, UPPER, ascii_lower, table

TOKEN = "[a-z0-9]+"
# The site rules of the contract.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Pattern rules of the default list: kinds of site, then an exception.
PATTERN_RULES = (("||spam-farm.", "block"), ("||adult-x.", "block"), ("||casino-win.", "block"),
                 ("||cheap-pills.", "block"), ("||free-bets.", "block"), ("||ads-track.", "block"),
                 ("^viagra^", "block"), ("^warez^", "block"), ("/wp-login.php|", "block"),
                 ("||edu^", "allow"))


@dataclass(frozen=True)
class Rule:
    kind: str
    rule: str
    action: str
    regex: str
    literals: tuple[str, ...]


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def site_rule(rule: str, action: str) -> Rule:
    """`host/path`, compared with host and path written together."""
    host, slash, path = rule.partition("/")
    whole = (slash + path).split("/")[1:-1]
    literals = [t for part in [*host.split("."), *whole] if re.fullmatch(TOKEN, part.lower()) for t in [part.lower()]]
    return Rule("site", rule, action, rf"^(?:[^/]*\.)?{_quoted(rule)}", tuple(dict.fromkeys(literals)))


def pattern_rule(pattern: str, action: str) -> Rule:
    body, head, tail = pattern.lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[a-z][a-z0-9+.\-]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    regex = "".join({"*": "[^\\n]*", "^": "(?:[^a-z0-9]|$)"}.get(c) or _quoted(c) for c in body)
    literals = []
    for m in re.finditer(TOKEN, body):
        left = head if m.start() == 0 else body[m.start() - 1] != "*"
        right = tail if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            literals.append(m[0])
    return Rule("pattern", pattern, action, head + regex + tail, tuple(dict.fromkeys(literals)))


def rule_frame(spark: SparkSession, site=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """The compiled rule list; lists that live in a table go through the same two functions."""
    rules = [site_rule(*r) for r in site] + [pattern_rule(*r) for r in patterns]
    return spark.createDataFrame(
        [(i, r.kind, r.rule, r.action, r.regex, list(r.literals)) for i, r in enumerate(rules)],
        "rule_no int, kind string, rule string, action string, regex string, literals array<string>")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def index_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules with column `token`, the rarest of their literals among `tokens` (url, token)."""
    wanted = rules.select(F.explode("literals").alias("token")).distinct()
    seen = tokens.join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    filed = (rules.select("rule_no", F.explode_outer("literals").alias("token")).join(seen, "token", "left")
             .groupBy("rule_no")
             .agg(F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), "token")).getField("token").alias("token")))
    return rules.join(filed, "rule_no").withColumn("token", F.coalesce("token", F.lit("")))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """One row per distinct URL: url, rule (site rule that won), verdict, pattern (pattern that won)."""
    distinct = urls.select(F.col(url).alias("url")).where("url is not null").distinct()
    low = ascii_lower(F.col("url"))
    tokens = distinct.select("url", F.explode(F.array_append(
        F.array_distinct(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))), "")).alias("token"))
    index = index_rules(tokens, rules)
    target = F.when(F.col("kind") == "site", F.concat(host_of(F.col("url")), path_of(F.col("url")))).otherwise(low)
    fits = (tokens.join(index.select("token", "kind", "rule", "action", "regex"), "token")
            .where(F.regexp_like(target, F.col("regex"))))
    site, pattern = F.col("kind") == "site", F.col("kind") == "pattern"
    rank = F.struct((-F.length("rule")).alias("size"), (F.col("action") == "allow").alias("allows"), "rule", "action")
    best = fits.groupBy("url").agg(
        F.min(F.when(site, rank)).alias("site"),
        F.min(F.when(pattern, F.struct((F.col("action") != "allow").alias("blocks"), "rule", "action"))).alias("pattern"))
    return best.select("url", F.col("site.rule").alias("rule"),
                       F.coalesce("site.action", "pattern.action").alias("verdict"),
                       F.col("pattern.rule").alias("pattern"))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, pattern of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    return (rows.join(judge(rows, rules), "url", "left")
            .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
                    F.coalesce("verdict", F.lit("allow")).alias("verdict"), "pattern"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rule_frame(spark))


def op2_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    site = ", ".join(f"({quote(r.partition('/')[0])}, {quote('/' + r.partition('/')[2])}, {quote(r)}, {quote(a)})"
                     for r, a in SITE_RULES)
    pats = ", ".join(f"({quote(p)}, {quote(a)}, {quote(pattern_rule(p, a).regex)})" for p, a in PATTERN_RULES)
    return f"""
WITH site(rhost, rpath, rule, action) AS (VALUES {site}),
pats(pattern, action, regex) AS (VALUES {pats}),
u AS (SELECT DISTINCT url,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT url, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT url, translate(raw, '{UPPER}', '{LOWER}') AS host, path,
        translate(url, '{UPPER}', '{LOWER}') AS low FROM h),
s AS (SELECT url, rule, action FROM (SELECT t.url, site.rule, site.action,
        row_number() OVER (PARTITION BY t.url ORDER BY length(site.rule) DESC, site.action DESC, site.rule) AS k
      FROM t JOIN site ON (t.host = rhost OR ends_with(t.host, '.' || rhost)) AND starts_with(t.path, rpath)) WHERE k = 1),
p AS (SELECT url, pattern, action FROM (SELECT t.url, pats.pattern, pats.action,
        row_number() OVER (PARTITION BY t.url ORDER BY pats.action = 'block', pats.pattern) AS k
      FROM t JOIN pats ON regexp_matches(t.low, pats.regex)) WHERE k = 1)
SELECT g.page_id, coalesce(t.host, '') AS host, coalesce(t.path, '') AS path, s.rule,
  coalesce(s.action, p.action, 'allow') AS verdict, p.pattern
FROM pages g LEFT JOIN t ON t.url = g.url LEFT JOIN s ON s.url = g.url LEFT JOIN p ON p.url = g.url"""
