"""Quality rules as weak supervision.

Every rule looks at a few counts of a document and votes good (1) or bad (-1), or
abstains (0). A document is good or bad, unseen; each rule votes good, bad or not at
all with its own probabilities in either class, which are its accuracies.
Expectation-maximisation estimates them and the share of good documents from the
votes of all documents, without labels, and the posterior probability of a good
document replaces the conjunction of all rules.

Kinds of junk exclude one another, so votes alone cannot tell a rule that finds a
kind of its own from a rule that errs. What a rule's author knows closes this gap: a
bound on its false alarms among good documents (`Rule.alarms`). Estimates stay within
the bounds.

The votes of a document form one of at most 2^rules patterns (a rule votes one way or
abstains), so the corpus is reduced to a table of (pattern, count) of that bounded
size. The iterations run over this one row of patterns inside Spark; its posteriors
join back on the pattern and are broadcast, as their number cannot exceed 2^rules.

Only column expressions are used. Repeated five-word windows are found by sorting
the window hashes of a document (XXH64; 64-bit collisions inside one document are
neglected), so a document of n words costs n log n, whatever it repeats.

Defined cases: null text = empty text, no words, fails the base rules; a document
without words votes bad where a rule needs words. Repeated rows count each. Ties of
the posterior (exactly one half) are kept. An empty table gives an empty result.
Input columns beyond id and text are ignored by `features`, kept by `keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import WORD, let, stored, table, words_of

WINDOW = 5
SYMBOLS = "#*$%&|<>"
# Frequent function words of the corpus languages.
FUNCTION_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was",
    "der", "die", "und", "den", "von", "das", "mit", "ist", "nicht", "ein",
    "le", "la", "les", "des", "et", "de", "du", "un", "une", "que",
    "el", "los", "del", "se", "por", "con", "para", "su", "al", "y",
    "di", "il", "che", "per", "non", "een", "het", "van", "em", "os")
ITERATIONS = 25
# Rules on shares that a line or a name can exceed in a short text ask for so many words.
LONG = 30
# Start of the iterations, and pseudo-documents that hold every estimate near it in
# small corpora: the chance that a rule votes, for rules that vote bad and rules that
# vote good, in either class, and the share of good documents.
START = {"bad": (0.002, 0.3), "good": (0.8, 0.5)}
START_SHARE, PSEUDO_DOCUMENTS = 0.8, 10.0
# A rule that votes bad finds at least this share of the bad documents.
FINDS = 0.05


def _count(pattern: str, text: Column) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that occur at least twice, the first included."""
    def windows(hashes):
        at = lambda i, k: F.get(hashes, i + F.lit(k))
        return F.when(F.size(hashes) >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW),
            lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))

    def covered(starts):
        return F.aggregate(
            F.transform(starts, lambda s, k: F.coalesce(F.least(F.get(starts, k + 1) - s, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("long"), lambda total, x: total + x)

    def of_positions(pairs):
        h = lambda k: F.get(pairs, k)["h"]
        twice = F.filter(pairs, lambda p, k: (p["h"] == h(k - 1)) | (p["h"] == h(k + 1)))
        return let(F.sort_array(F.transform(twice, lambda p: p["i"])), covered)

    def of_windows(found):
        return F.when(let(F.sort_array(found), lambda s: F.exists(
            F.transform(s, lambda x, k: F.coalesce(x == F.get(s, k + 1), F.lit(False))), lambda x: x)),
            let(F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), of_positions))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(let(hashes, lambda x: let(windows(x), of_windows)), F.lit(0)).cast("long")


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the counts of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(*keep, body.alias("__text"), words_of(body).alias("__words"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD))
    lists = held.select("*", lines.alias("__lines"))
    t, w = F.col("__text"), F.col("__words")
    stop = F.array(*[F.lit(x) for x in FUNCTION_WORDS])
    return lists.select(
        *keep, F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _count("[^#*$%&|<>]+", t).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        _count("[^\\p{Lu}]+", t).alias("n_upper"),
        _count("[^!]+", t).alias("n_shouts"),
        F.size(F.array_intersect(w, stop)).cast("long").alias("n_function_words"),
        F.size(F.filter("__lines", lambda x: x.rlike("[.!?;:,)»”\"'][\\x20\\x09-\\x0D]*\\z"))).cast("long").alias("n_closed_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A rule that votes `votes` where its condition holds and abstains elsewhere;
    `alarms` bounds the share of good documents for which a rule votes bad."""
    name: str
    votes: str
    alarms: float = 1.0


RULES = (Rule("symbols", "bad", 0.002), Rule("some_symbols", "bad", 0.02), Rule("upper_case", "bad", 0.002),
         Rule("some_upper_case", "bad", 0.02), Rule("shouting", "bad", 0.002), Rule("repeated_lines", "bad", 0.01),
         Rule("repeated_words", "bad", 0.02), Rule("long_words", "bad", 0.005), Rule("function_words", "good"),
         Rule("closed_lines", "good"))


def conditions() -> dict[str, Column]:
    """When each rule votes, by the counts of a document, all in whole numbers."""
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    above = lambda part, whole, percent: F.col(part) * 100 > whole * percent
    return {
        "symbols": above("n_symbols", n, 10), "some_symbols": above("n_symbols", n, 3),
        "upper_case": above("n_upper", chars, 30), "some_upper_case": above("n_upper", chars, 15) & (n >= LONG),
        "shouting": above("n_shouts", n, 20), "repeated_lines": above("n_dup_lines", lines, 30) & (n >= LONG),
        "repeated_words": above("n_repeat_words", n, 10), "long_words": chars > 25 * n,
        "function_words": F.col("n_function_words") >= 2, "closed_lines": 2 * F.col("n_closed_lines") >= lines,
    }


def pattern_code() -> Column:
    """The set of rules that vote, as one number."""
    when = conditions()
    return reduce(lambda code, rule: code * 2 + F.when(when[rule.name], 1).otherwise(0), RULES, F.lit(0)).cast("int")


def posteriors(codes: DataFrame, of: tuple[Rule, ...] = RULES, code: str = "code", iterations: int = ITERATIONS) -> DataFrame:
    """(code, posterior, in_good, in_bad) of each vote pattern that occurs, by expectation-maximisation.

    `in_good` and `in_bad` hold the chance of each rule in turn to vote in the two classes.
    """
    voters = F.filter(F.sequence(F.lit(0), F.lit(len(of) - 1)),
                      lambda j: F.getbit(F.col(code), F.lit(len(of) - 1) - j) == 1)
    counts = codes.groupBy(code).agg(F.count(F.lit(1)).cast("double").alias("n"))
    # At most 2^rules rows meet here.
    corpus = counts.select(F.struct(F.col(code).alias("code"), "n", voters.alias("v")).alias("p")).agg(
        F.sort_array(F.collect_list("p")).alias("patterns"))
    fixed = lambda values: F.array(*[F.lit(float(x)) for x in values])
    starts = [fixed(START[r.votes][side] for r in of) for side in (0, 1)]
    highest = [fixed(min(r.alarms, 0.99) for r in of), fixed(0.99 for _ in of)]
    lowest = [fixed(0.0005 for _ in of), fixed(FINDS for _ in of)]

    def scored(patterns, state):
        silent = lambda g, b: F.log((1.0 - g) / (1.0 - b))
        ratios = F.zip_with(state["in_good"], state["in_bad"], lambda g, b: F.log(g / b) - silent(g, b))
        odds = F.aggregate(F.zip_with(state["in_good"], state["in_bad"], silent),
                           F.log(state["share"] / (1.0 - state["share"])), lambda s, x: s + x)
        return let(F.struct(ratios.alias("r"), odds.alias("o")), lambda m: F.transform(patterns, lambda p: F.struct(
            p["code"].alias("code"), p["n"].alias("n"), p["v"].alias("v"),
            (1.0 / (1.0 + F.exp(-F.aggregate(p["v"], m["o"], lambda s, j: s + F.get(m["r"], j))))).alias("q"))))

    def total(items, value):
        return F.aggregate(items, F.lit(0.0), lambda s, x: s + x["n"] * value(x))

    def improved(items):
        def chances(weight, side):
            return let(total(items, weight), lambda whole: F.transform(starts[side], lambda start, j: F.greatest(
                F.get(lowest[side], j), F.least(F.get(highest[side], j), (
                    total(items, lambda x: F.when(F.array_contains(x["v"], j), weight(x)).otherwise(0.0))
                    + PSEUDO_DOCUMENTS * start) / (whole + PSEUDO_DOCUMENTS)))))
        good, bad = lambda x: x["q"], lambda x: 1.0 - x["q"]
        return F.struct(
            ((total(items, good) + PSEUDO_DOCUMENTS * START_SHARE)
             / (total(items, lambda x: F.lit(1.0)) + PSEUDO_DOCUMENTS)).alias("share"),
            chances(good, 0).alias("in_good"), chances(bad, 1).alias("in_bad"))

    start = F.struct(F.lit(START_SHARE).alias("share"), starts[0].alias("in_good"), starts[1].alias("in_bad"))
    fitted = corpus.select("patterns", F.aggregate(
        F.sequence(F.lit(1), F.lit(iterations)), start,
        lambda state, i: let(scored(F.col("patterns"), state), improved)).alias("state"))
    return (fitted.select("state", F.explode(scored(F.col("patterns"), F.col("state"))).alias("x"))
            .select(F.col("x.code").alias("code"), F.col("x.q").alias("posterior"), "state.in_good", "state.in_bad"))


def judged(counted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`counted` (rows of `features`, stored, as they are read twice) with code, base_failed, posterior and kept."""
    coded = counted.select("*", pattern_code().alias("code"), base_failed().alias("base_failed"))
    fitted = posteriors(coded.select("code")).select("code", "posterior")
    # At most 2^rules rows, whatever the corpus.
    return (coded.join(F.broadcast(fitted), "code")
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with their columns. The rows are stored once with their
    vote pattern, so that texts are counted once and move nowhere."""
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias("__doc"),
                        F.col(text).alias("__body"))
    counted = features(whole, "__body", ("__doc",))
    coded = stored(counted.select("__doc", pattern_code().alias("code"), base_failed().alias("base_failed")),
                   "quality")
    fitted = posteriors(coded.select("code")).select("code", "posterior")
    return (coded.join(F.broadcast(fitted), "code")
            .where(~F.col("base_failed") & (F.col("posterior") >= 0.5))
            .select(*[F.col("__doc").getField(c).alias(c) for c in columns]))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stored(features(table(spark, sf_dir, "documents")), "quality")
    return judged(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_sql() -> str:
    """The same counts, votes and iterations in SQL; each iteration is a subquery of the next."""
    of = RULES
    votes = ("n_symbols * 100 > n_words * 10", "n_symbols * 100 > n_words * 3", "n_upper * 100 > word_chars * 30",
             f"n_upper * 100 > word_chars * 15 AND n_words >= {LONG}", "n_shouts * 100 > n_words * 20", f"n_dup_lines * 100 > n_lines * 30 AND n_words >= {LONG}",
             "n_repeat_words * 100 > n_words * 10", "word_chars > 25 * n_words", "n_function_words >= 2",
             "2 * n_closed_lines >= n_lines")
    places = range(len(of))
    stop = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    left = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))"
    odds = "ln(share / (1 - share)) + " + " + ".join(
        f"CASE WHEN v{j} THEN ln(g{j} / b{j}) ELSE ln((1 - g{j}) / (1 - b{j})) END" for j in places)
    scored = lambda params: f"(SELECT p.*, 1 / (1 + exp(-({odds}))) AS q FROM patterns p, {params} m)"
    m = PSEUDO_DOCUMENTS
    chance = lambda w, j, start, low, high: (
        f"greatest({low}, least({high}, (coalesce(sum(n * ({w})) FILTER (v{j}), 0) + {m} * {start}) / (sum(n * ({w})) + {m})))")
    start = lambda side, j: START[of[j].votes][side]
    params = "(SELECT {}::DOUBLE AS share, {})".format(START_SHARE, ", ".join(
        f"{start(side, j)}::DOUBLE AS {name}{j}" for side, name in ((0, "g"), (1, "b")) for j in places))
    steps = [f"e0 AS MATERIALIZED {params}"]
    for k in range(ITERATIONS):
        new = ", ".join([f"(sum(n * q) + {m * START_SHARE}) / (sum(n) + {m}) AS share",
                         *[chance("q", j, start(0, j), 0.0005, min(of[j].alarms, 0.99)) + f" AS g{j}" for j in places],
                         *[chance("1 - q", j, start(1, j), FINDS, 0.99) + f" AS b{j}" for j in places]])
        steps.append(f"e{k + 1} AS MATERIALIZED (SELECT {new} FROM {scored(f'e{k}')})")
    v_list = ", ".join(f"v{j}" for j in places)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
k AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS x FROM (
  SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM p) WHERE c > 1) GROUP BY r),
c AS (SELECT w.r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {left('[^#*$%&|<>]+')} AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words, len(lines) AS n_lines,
  {left('[^\\p{Lu}]+')} AS n_upper, {left('[^!]+')} AS n_shouts, len(list_filter(list_distinct(w), lambda x: x IN ({stop}))) AS n_function_words,
  len(list_filter(lines, lambda x: regexp_matches(x, '[.!?;:,)»”"''][\\x20\\x09-\\x0D]*\\z'))) AS n_closed_lines
  FROM w LEFT JOIN k ON k.r = w.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"{x} AS v{j}" for j, x in enumerate(votes))} FROM c),
patterns AS MATERIALIZED (SELECT {v_list}, count(*)::DOUBLE AS n FROM f GROUP BY ALL),
{", ".join(steps)},
q AS MATERIALIZED {scored(f"e{ITERATIONS}")}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept FROM f JOIN q USING ({v_list})"""
