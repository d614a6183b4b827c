"""Plain versions of the quality rules, written from their definition."""
import math
import re
from collections import Counter

from chronoline.llm import quality

WORD = re.compile("[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_upper": sum(c.isupper() and __import__("unicodedata").category(c) == "Lu" for c in text), "n_shouts": text.count("!"),
        "n_function_words": len(set(words) & set(quality.FUNCTION_WORDS)),
        "n_closed_lines": sum(bool(re.search("[.!?;:,)»”\"'][\x20\x09-\x0D]*\\Z", x)) for x in lines)}


def votes(c):
    n = c["n_words"]
    more = lambda part, whole, percent: part * 100 > whole * percent
    return (more(c["n_symbols"], n, 10), more(c["n_symbols"], n, 3), more(c["n_upper"], c["word_chars"], 30),
            more(c["n_upper"], c["word_chars"], 15) and n >= 30, more(c["n_shouts"], n, 20), more(c["n_dup_lines"], c["n_lines"], 30) and n >= 30,
            more(c["n_repeat_words"], n, 10), c["word_chars"] > 25 * n, c["n_function_words"] >= 2,
            2 * c["n_closed_lines"] >= c["n_lines"])


def base_failed(c):
    return c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]


def posteriors(patterns):
    """{pattern: posterior} for a Counter of vote patterns."""
    of = quality.RULES
    start = [[quality.START[r.votes][side] for r in of] for side in (0, 1)]
    good, bad, share = *start, quality.START_SHARE

    def scored():
        out = {}
        for p in patterns:
            odds = math.log(share / (1 - share)) + sum(
                math.log(g / b) if v else math.log((1 - g) / (1 - b)) for v, g, b in zip(p, good, bad, strict=True))
            out[p] = 1 / (1 + math.exp(-odds))
        return out
    for _ in range(quality.ITERATIONS):
        q, m = scored(), quality.PSEUDO_DOCUMENTS
        weigh = lambda w, j: sum(n * w(q[p]) for p, n in patterns.items() if j is None or p[j])
        new = [[min(high, max(low, (weigh(w, j) + m * start[side][j]) / (weigh(w, None) + m)))
                for j, (low, high) in enumerate(bounds)]
               for side, w, bounds in ((0, lambda x: x, [(0.0005, min(r.alarms, 0.99)) for r in of]),
                                       (1, lambda x: 1 - x, [(quality.FINDS, 0.99)] * len(of)))]
        share = (weigh(lambda x: x, None) + m * quality.START_SHARE) / (sum(patterns.values()) + m)
        good, bad = new
    return scored()


def kept(texts):
    """Whether each text passes, judged among the given texts."""
    counted = [counts(t) for t in texts]
    patterns = [votes(c) for c in counted]
    q = posteriors(Counter(patterns))
    return [not base_failed(c) and q[p] >= 0.5 for c, p in zip(counted, patterns, strict=True)]
