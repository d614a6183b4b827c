"""License scans by a positional index of rare words.

Templates are short license texts. How many documents of the corpus hold each template
word is counted over all documents; each template is indexed by its `anchors` words of
highest inverse document frequency, word -> (template, position). A file looks up its
words in this index: each place of an indexed word votes for the template at the
relative position (place minus template position), and only positions where enough
anchors agree (within the template's slack) are compared further. There the mandatory
key phrases must stand at their places (within the slack), and the score is the share
of the template's words, weighted by inverse document frequency, that stand exactly at
their relative place.

Phrase templates have one anchor, no slack and must match whole, so every place of a
phrase is found: it holds the phrase's rarest word there.

The index has the size of the template list. The counting pass is one aggregation with
map-side combination; the scan runs where the rows are read, without a shuffle.

Defined cases: null = empty text: no words, no match, score 0. Null ids and repeated
rows are carried along. Very long texts are whole. Words equally frequent are taken in
template order. Other columns are not returned. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import ascii_lower, small_batches, table

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD_BYTES = re.compile(WORD.encode())
ANCHORS, SLACK, LEAST_SCORE = 3, 4, 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...] = ()  # mandatory key phrases
    phrase_only: bool = False      # the text is itself the phrase looked for


# The phrases of the contract.
PHRASES = (Template("mit", "under the mit license", (), True), Template("apache-2", "apache license version 2", (), True),
           Template("cc-by-nc", "cc by nc", (), True))
# Notices and opening clauses of public licenses.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files the software to deal in the software without restriction",
             ("hereby granted free of charge", "without restriction")),
    Template("mit", "released under the mit license", ("under the mit license",)),
    Template("mit", "the mit license", ("the mit license",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the "
                      "license or at your option any later version", ("gnu general public license", "either version 3")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
                    "that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
                    "hereby granted", ("with or without fee",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution 4",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
)


def words_of(text: str | None) -> list[bytes]:
    return WORD_BYTES.findall((text or "").encode().lower())


@dataclass
class Index:
    """Templates with the weights of their words, and the postings of their rarest ones."""
    templates: list[Template]
    weight: dict[bytes, float]
    anchors: int = ANCHORS
    words: list[list[bytes]] = field(default_factory=list)
    total: list[float] = field(default_factory=list)
    phrases: list[list[tuple[int, list[bytes]]]] = field(default_factory=list)
    needed: list[int] = field(default_factory=list)
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self):
        for t, template in enumerate(self.templates):
            words = words_of(template.text)
            rare = sorted(dict.fromkeys(words), key=lambda w: -self.weight[w])
            rare = rare[:1 if template.phrase_only else self.anchors]
            for position, word in enumerate(words):
                if word in rare:
                    self.postings[word].append((t, position))
            self.words.append(words)
            self.total.append(sum(self.weight[w] for w in words))
            self.needed.append(max(1, len(rare) - 1))
            self.phrases.append([(next(p for p in range(len(words)) if words[p:p + len(k)] == k), k)
                                 for k in map(words_of, template.phrases)])

    def matches(self, words: list[bytes]) -> list[tuple[str, bool, int, float]]:
        """(label, whether a phrase template, start, score), in order of place."""
        if self.postings.keys().isdisjoint(words):
            return []
        votes = defaultdict(set)
        for place, word in enumerate(words):
            for t, position in self.postings.get(word, ()):
                votes[t, place - position].add(word)
        found = []
        for t, start in sorted(votes):
            template, slack = self.templates[t], 0 if self.templates[t].phrase_only else SLACK
            agreeing = set().union(*(votes.get((t, start + s), ()) for s in range(-slack, slack + 1)))
            if len(agreeing) < self.needed[t]:
                continue
            if not all(any(at >= 0 and words[at:at + len(k)] == k for at in range(start + p - slack, start + p + slack + 1))
                       for p, k in self.phrases[t]):
                continue
            same = [start + p >= 0 and words[start + p:start + p + 1] == [w] for p, w in enumerate(self.words[t])]
            score = sum(self.weight[w] for w, s in zip(self.words[t], same, strict=True) if s) / self.total[t]
            if all(same) if template.phrase_only else score >= LEAST_SCORE:
                found.append((template.label, template.phrase_only, max(0, start), min(1.0, score)))
        return sorted(found, key=lambda m: m[2])


def document_frequencies(docs: DataFrame, templates, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """The number of documents, and of those that hold each template word."""
    vocabulary = sorted({w.decode() for t in templates for w in words_of(t.text)})
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    held = docs.select(F.array_intersect(words, F.array(*[F.lit(w) for w in vocabulary])).alias("w"))
    # One row for each template word at most, and one for the total.
    counted = held.select(F.explode(F.array_append("w", "")).alias("w")).groupBy("w").count().collect()
    counts = {r["w"].encode(): r["count"] for r in counted}
    return counts.get(b"", 0), {w.encode(): counts.get(w.encode(), 0) for w in vocabulary}


def build_index(docs: DataFrame, templates=PHRASES + NOTICES, text: str = "text", anchors: int = ANCHORS) -> Index:
    n, counts = document_frequencies(docs, templates, text)
    return Index(list(templates), {w: math.log((n + 2) / (c + 1)) for w, c in counts.items()}, anchors)


MATCHES = "array<struct<label:string,phrase:boolean,start:long,score:double>>"


def scan(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and the matches of each document."""
    small_batches(docs.sparkSession)
    match = pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            sizes, found = [], []
            for body in batch.column(1):
                words = words_of(body.as_py())
                sizes.append(len(words))
                found.append([dict(zip(match.names, m, strict=True)) for m in index.matches(words)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(match))],
                names=["doc_id", "n_words", "matches"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id long, n_words long, matches {MATCHES}")


def summary(scanned: DataFrame) -> DataFrame:
    base = F.filter("matches", lambda m: m["phrase"])
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda items: F.array_join(F.sort_array(F.array_distinct(F.transform(items, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return summary(scan(docs, build_index(docs)))
