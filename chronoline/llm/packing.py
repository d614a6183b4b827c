"""Cost-balanced sequence packing.

A document is tokenised and ends with the end token. The cost of a piece of n tokens
is n + n * n / `quadratic_at`: linear layers plus attention inside the piece. Tokens
beyond a multiple of the sequence length are cut off in whole sequences first. The
remaining pieces of a buffer of `block` sequences are assigned in descending order,
each to the sequence of lowest cost that still has room for it; pieces that fit
nowhere are then cut to fill the gaps, so every sequence is full. What is left starts
the next buffer. The last tokens of a partition are cut at powers of two, which need
no padding.

The work is one pass over the rows where they are read: no shuffle, memory for one
Arrow batch, one buffer (`block` x `max_tokens` tokens) and a bounded word cache.
Sequence ids hold the partition's number, so equal plans give equal ids, also when a
lost task runs again.

Token ids of a text are those of its parts between blanks and line ends, as no token
of the vocabulary spans white space; parts are looked up in a cache of at most twice
`CACHE_WORDS` entries and go through the tokenizer when they are not found there.

Defined cases: null text = empty text = the end token alone. Null or repeated ids are
carried along; each row is packed. An empty table gives no sequence. Very long texts
are whole. Other columns are not returned.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoline.llm.common import small_batches, table

MAX_TOKENS, END = 2048, 1
CACHE_WORDS = 500_000
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long, cost double")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: its own if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Words(dict):
    """Token ids (little-endian, 32 bits) by word; the words of the last generation are kept too.

    The tokenizer lower-cases, and splits a letter from a mark after it, so marks and
    capitals (of Latin-1, where both are free of context) share the entry of the word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer, self.old = Tokenizer.from_file(path), {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self._ids(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def _ids(self, word: str) -> bytes:
        # The one letter that lower-cases into a letter and a mark is left to the tokenizer.
        if len(word) > 1 and word[-1] in ".,;:!?" and word[-2].isalpha() and word[-2] != "\u0130":
            return self[word[:-1]] + self[word[-1]]
        # A special token in capitals is ordinary text.
        if word and "|" not in word and max(word) <= "\xff":
            if word != (low := word.lower()):
                return self[low]
            # Small letters alone are one piece, which no normalisation changes.
            if word.isalpha():
                pieces = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
                return np.array([p.id for p in pieces], dtype="<u4").tobytes()
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=4)
def _words(path: str | None) -> _Words:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return _Words(path)


def token_bytes(text: str | None, words: _Words) -> bytes:
    """Ids of the text, four bytes each, with the end token."""
    parts = (text or "").replace("\n", " ").split(" ")
    return b"".join(map(words.__getitem__, parts)) + END.to_bytes(4, "little")


class Packer:
    """Packs pieces (doc_id, start, ids as bytes, doc_tokens); `done` collects rows of SCHEMA."""

    def __init__(self, max_tokens: int, quadratic_at: float, block: int, first_id: int):
        self.size, self.quadratic_at, self.block = max_tokens, quadratic_at, block
        self.next_id, self.buffer, self.held, self.done = first_id, [], 0, []

    def cost(self, n: int) -> float:
        return n + n * n / self.quadratic_at

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            self._sequence([(doc_id, start, ids[4 * start:4 * (start + self.size)], total)])
        if total > whole:
            self.buffer.append((doc_id, whole, ids[4 * whole:], total))
            self.held += total - whole
            if self.held >= self.block * self.size:
                self._pack()

    def finish(self) -> None:
        self._pack()
        left = self.held
        while left:
            size = 1 << (left.bit_length() - 1)
            self._sequence(self._take(self.buffer, size))
            left -= size
        self.held = 0

    def _sequence(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc_id, start, n, ids, total, self.next_id, offset, self.cost(n)))
            offset += n
        self.next_id += 1

    @staticmethod
    def _take(pieces: list, size: int) -> list:
        """The last `size` tokens' worth of pieces off the list, the last one cut."""
        taken = []
        while size and pieces:
            doc_id, start, ids, total = pieces.pop()
            n = len(ids) // 4
            if n > size:
                pieces.append((doc_id, start + size, ids[4 * size:], total))
                ids, n = ids[:4 * size], size
            taken.append((doc_id, start, ids, total))
            size -= n
        return taken

    def _pack(self) -> None:
        n = self.held // self.size
        if not n:
            return
        room, cost = np.full(n, self.size), np.zeros(n)
        bins, rest = [[] for _ in range(n)], []
        for piece in sorted(self.buffer, key=lambda p: -len(p[2])):
            length = len(piece[2]) // 4
            best = int(np.argmin(np.where(room >= length, cost, np.inf)))
            if room[best] < length:
                rest.append(piece)
                continue
            bins[best].append(piece)
            room[best] -= length
            cost[best] += self.cost(length)
        for k in np.argsort(cost, kind="stable"):
            self._sequence(bins[k] + self._take(rest, int(room[k])))
        self.buffer, self.held = rest, self.held - n * self.size


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
         max_tokens: int = MAX_TOKENS, quadratic_at: float = 4096.0, block: int = 256) -> DataFrame:
    """Pieces of all documents with their token ids and places in sequences."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                        ("cost", pa.float64())])

    def run(batches):
        words = _words(tokenizer)
        packer = Packer(max_tokens, quadratic_at, block, TaskContext.get().partitionId() << 40)

        def rows():
            columns = list(zip(*packer.done, strict=True)) or [()] * len(schema)
            packer.done = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                                              schema=schema)
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(key, token_bytes(body.as_py(), words))
                if len(packer.done) >= 2000:
                    yield rows()
        packer.finish()
        yield rows()

    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "cost")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))
