"""Alignment of two tokenizers over the same bytes, and corpus-wide links of their ids.

Tokenizer A (byte-level) encodes a blank and the text, B (pieces) the text, to which it
adds the blank itself. Every token stands for bytes. If both token lists join to the
bytes of blank + text, a dictionary leads from each cumulative end to the token that
ends there, one for A and one for B. The ends held by both dictionaries (a hash-set
intersection), in order, cut both lists into groups; inside a group the tokens whose
byte ranges overlap are linked. Other texts have no tokens.

No token of either tokenizer spans a single blank between two other characters, so both
end there and the parts between such blanks are aligned by themselves; parts met
before come from a bounded cache. That holds for Latin letters and is checked on B's
vocabulary; texts with other letters are aligned whole.

The first pass runs where the rows are read. It deals documents into chunks of about
`chunk_links` links and adds up links by id pair inside a chunk, so what is shuffled
for the corpus-wide counts is one row per (chunk, pair). The counts come back to the
chunk's pairs by a join, and each chunk's documents meet them in one group: its
documents hold places in the chunk's pair list, two bytes a link (four in a chunk of
more than 65,536 pairs). One document is never cut, so a chunk exceeds `chunk_links` by its last
document at most.

`align` returns the documents, `link_table` how often each id pair is linked and
whether it is the best of its B id, `score` both together.

Defined cases: null or empty text, or one that B normalises (say, full-width letters):
no tokens, zeros, empty groups. Null ids and repeated rows are carried along, each row
counts. Ties for the best are all best. Very long texts are whole. An empty table gives
an empty result; other columns are not returned.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import small_batches, stored, table

BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_LINKS = 1 << 20
CACHED_PARTS = 200_000
# Python's white space holds that of both tokenizers, so fewer blanks cut, never more.
SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")


NO_TOKENS = (0, 0, 0, "", b"")


def _latin(text: str) -> bool:
    return text.isascii() or max(text) < "\u0250"


def _path(name: str) -> str:
    """The place of a public tokenizer's file; other paths are taken as they are."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _letter_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """Tokenizer A: ids of texts with a blank before them, and the bytes of each id.

    Where the same vocabulary is there as ranks, it encodes the texts of Latin letters,
    five times faster and to the same ids; all others go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _letter_bytes()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.ranks = None
        if os.path.exists(ranks := path.removesuffix(".json") + ".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            if all(self.bytes[i] == a for a, i in merges.items()):
                self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
                                               special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.ranks and _latin(text):
            return self.ranks.encode_ordinary(" " + text)
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class PieceTokens:
    """Tokenizer B: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.model.id_to_piece
        self.bytes = [bytes([int(piece(i)[3:-1], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode()
                      for i in range(self.model.get_piece_size())]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class _Parts(dict):
    """What `aligned_part` gives for each part; the parts of the last generation are kept too."""

    def __init__(self, aligned_part):
        self.aligned_part, self.old = aligned_part, {}

    def __missing__(self, part: str):
        out = self.old.get(part) or self.aligned_part(part)
        if len(self) >= CACHED_PARTS:
            self.old = dict(self)
            self.clear()
        self[part] = out
        return out


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = ByteTokens(_path(a)), PieceTokens(_path(b))
        # The blank of a piece can only stand at its start.
        self.by_parts = self.a.ranks is not None and not any(b" " in p.lstrip(b" ") for p in self.b.bytes)
        self.parts = _Parts(self.aligned_part)
        self.size_a, self.size_b = [list(map(len, t.bytes)) for t in (self.a, self.b)]
        self.name_a, self.name_b = [list(map(str, range(len(t.bytes)))) for t in (self.a, self.b)]

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of A and B, both empty where either differs from the bytes of blank + text."""
        if not text:
            return [], []
        a, b, whole = self.a.ids(text), self.b.ids(text), b" " + text.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != whole or b"".join(map(self.b.bytes.__getitem__, b)) != whole:
            return [], []
        return a, b

    def align(self, text: str | None) -> tuple[int, int, int, str, bytes]:
        """Numbers of A tokens, B tokens and groups, the groups as text, and the pairs of all links (64 bits each)."""
        if not text or not self.by_parts or not _latin(text):
            return self.aligned_part(text)
        found = list(map(self.parts.__getitem__, SINGLE_BLANK.split(text)))
        n_a, n_b, n_groups, groups, links = zip(*found, strict=True)
        if not all(n_a):
            return NO_TOKENS
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)

    def aligned_part(self, text: str | None) -> tuple[int, int, int, str, bytes]:
        a, b = self.tokens(text)
        if not a:
            return NO_TOKENS
        ends_a = list(accumulate(map(self.size_a.__getitem__, a)))
        ends_b = list(accumulate(map(self.size_b.__getitem__, b)))
        token_a, token_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
        names_a, names_b = list(map(self.name_a.__getitem__, a)), list(map(self.name_b.__getitem__, b))
        groups, links = [], array("q")
        add_group, add_link = groups.append, links.append
        i = j = 0
        for end in sorted(token_a.keys() & token_b.keys()):
            to_a, to_b = token_a[end], token_b[end]
            if to_a - i == 1 and to_b - j == 1:
                add_group(f"{names_a[i]}|{names_b[j]}")
                add_link(a[i] << 32 | b[j])
            else:
                add_group(f"{','.join(names_a[i:to_a])}|{','.join(names_b[j:to_b])}")
                # No ends meet inside a group: after each link the token that ends first gives way.
                while True:
                    add_link(a[i] << 32 | b[j])
                    if ends_a[i] < ends_b[j]:
                        i += 1
                    elif ends_b[j] < ends_a[i]:
                        j += 1
                    else:
                        break
            i, j = to_a, to_b
        return len(a), len(b), len(groups), ";".join(groups), links.tobytes()


@functools.lru_cache(maxsize=2)
def _aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


# Rows of documents, and one row of each chunk with its distinct pairs and their numbers.
ROWS = pa.schema([
    ("chunk", pa.int64()), ("is_document", pa.bool_()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string()),
    ("place_bytes", pa.int32()), ("places", pa.binary()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
ROWS_SQL = ("chunk long, is_document boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
            "groups_sha256 string, place_bytes int, places binary, pairs array<long>, times array<long>")


def _chunk(number: int, rows: list, links: list) -> pa.RecordBatch:
    """The rows of a chunk and its pair row. A pair is A's id in the upper and B's in the lower 32 bits."""
    codes = np.concatenate(links)
    pairs, places, times = np.unique(codes, return_inverse=True, return_counts=True)
    at = np.cumsum([0, *map(len, links)])
    wide = 2 if len(pairs) <= 1 << 16 else 4
    places = places.astype(f"<u{wide}")
    out = [(number, True, *row, wide, places[s:e].tobytes(), None, None) for row, s, e in zip(rows, at[:-1], at[1:], strict=True)]
    out.append((number, False, *[None] * 9, pairs, times))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROWS, strict=True)],
                                      schema=ROWS)


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a: str = BYTE_TOKENIZER, b: str = PIECE_TOKENIZER,
          chunk_links: int = CHUNK_LINKS, keep_groups: bool = True) -> DataFrame:
    """Stored rows of documents and chunks (ROWS). `groups` is `a1,a2|b1;a3|b2,b3` in ids,
    kept as a text with `keep_groups`, and always as its digest ('' without tokens)."""
    def run(batches):
        aligner, number = _aligner(a, b), TaskContext.get().partitionId() << 32
        rows, links, held = [], [], 0
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n_a, n_b, n_groups, groups, linked = aligner.align(body.as_py())
                rows.append((key, n_a, n_b, n_groups, len(linked) // 8, groups if keep_groups else None,
                             hashlib.sha256(groups.encode()).hexdigest() if groups else ""))
                links.append(np.frombuffer(linked, np.int64))
                held += len(links[-1]) + 16
                if held >= chunk_links:
                    yield _chunk(number, rows, links)
                    rows, links, held, number = [], [], 0, number + 1
        if rows:
            yield _chunk(number, rows, links)

    small_batches(docs.sparkSession, 200)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(plain.mapInArrow(run, ROWS_SQL), "alignment")


def _chunk_pairs(aligned: DataFrame) -> DataFrame:
    return aligned.where("not is_document").select("chunk", F.posexplode(F.arrays_zip("pairs", "times"))).select(
        "chunk", "pos", F.col("col.pairs").alias("pair"), F.col("col.times").alias("times"))


def link_table(aligned: DataFrame) -> DataFrame:
    """pair, a_id, b_id, links over all documents, and whether no other A id is linked to the B id more often."""
    totals = stored(_chunk_pairs(aligned).groupBy("pair").agg(F.sum("times").alias("links")).select(
        "pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "links"),
        "links")
    most = totals.groupBy("b_id").agg(F.max("links").alias("most"))
    return totals.join(most, "b_id").select("pair", "a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"


def score(aligned: DataFrame) -> DataFrame:
    """The documents with n_best, the links that are the best of their B id, and count_sum, the counts of all links."""
    known = _chunk_pairs(aligned).join(link_table(aligned), "pair").select(F.col("chunk").alias("of_chunk"), "pos", "links", "best")
    schema = pa.schema([ROWS.field(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                       + [("n_best", pa.int64()), ("count_sum", pa.int64()), ROWS.field("groups"), ROWS.field("groups_sha256")])

    def meet(documents: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["pos"].to_numpy())
        links = pairs["links"].to_numpy()[order]
        best = pairs["best"].to_numpy()[order].astype(np.int64)
        sums, bests = [], []
        for wide, places in zip(documents["place_bytes"], documents["places"], strict=True):
            at = np.frombuffer(places.as_buffer(), f"<u{wide.as_py()}")
            sums.append(int(links[at].sum()))
            bests.append(int(best[at].sum()))
        columns = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table([columns[f.name] if f.name in columns else documents[f.name] for f in schema], schema=schema)

    documents = aligned.where("is_document").drop("is_document", "pairs", "times")
    return documents.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(meet, SCORED)


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(align(table(spark, sf_dir, "documents"), keep_groups=False)).drop("groups")
