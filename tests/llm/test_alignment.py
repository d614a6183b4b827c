import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronoline.llm import alignment

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PRINTS = [b for b in range(256) if 0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or 0xAE <= b]
LETTER = {chr(b): b for b in PRINTS}
LETTER |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PRINTS)}


def spans(ids, size):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(size(i))))
        at += len(size(i))
    return out


def bytes_a(i):
    return bytes(LETTER[c] for c in A.id_to_token(i))


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()


def brute_document(text):
    """(A spans, B spans, groups, links): overlaps are read off byte by byte."""
    if not text:
        return [], [], "", Counter()
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(bytes_a, ids_a)) != whole or b"".join(map(bytes_b, ids_b)) != whole:
        return [], [], "", Counter()
    a, b = spans(ids_a, bytes_a), spans(ids_b, bytes_b)
    owner = lambda tokens: [k for k, (_, s, e) in enumerate(tokens) for _ in range(s, e)]
    links = sorted(set(zip(owner(a), owner(b), strict=True)))
    common = sorted({e for *_, e in a} & {e for *_, e in b})
    at, groups = 0, []
    for end in common:
        part = ["," .join(str(i) for i, s, e in side if at <= s and e <= end) for side in (a, b)]
        groups.append("|".join(part))
        at = end
    return a, b, ";".join(groups), Counter((ids_a[x], ids_b[y]) for x, y in links)


def brute(rows):
    documents = [(i, *brute_document(t)) for i, t in rows]
    total = Counter()
    for *_, links in documents:
        total.update(links)
    most = defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    return sorted(((i, len(a), len(b), groups.count(";") + bool(groups), sum(links.values()),
                    sum(n for p, n in links.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in links.items()),
                    hashlib.sha256(groups.encode()).hexdigest() if groups else "") for i, a, b, groups, links in documents), key=str)


def rows(docs, **options):
    got = alignment.score(alignment.align(docs, **options))
    for r in got.collect():
        if r.groups is not None:
            assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    return sorted((tuple(r) for r in got.drop("groups").collect()), key=str)


@pytest.mark.parametrize("chunk_links", [1 << 20, 3000])
def test_whole_table(spark, chunk_links):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    assert rows(docs, chunk_links=chunk_links, keep_groups=False) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_cases(spark):
    texts = [(1, None), (2, ""), (3, " "), (4, "  two  blanks \n\n lines\t."), (5, "<|endoftext|> and <s> </s> <0x41> <unk>"),
             (6, "Ｈｅｌｌｏ wide"), (7, "▁ block"), (8, "naïve 你好 \U0001f600 рус"),
             (None, "null id"), (9, "same"), (9, "same"), (10, "long text " * 2500), (11, "\x00\x01"), (12, "é ﬁ")]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in texts], "doc_id long, text string, pairs string, chunk int")
    got = rows(docs)
    assert got == brute(texts)
    assert {r[0]: r[1:] for r in got}[7] == (0, 0, 0, 0, 0, 0, "")
    assert rows(docs.where("false")) == []


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=st.sampled_from("aBé's  \n\t\x1c\x85\xa0\x009<|>ñɐ.,-▁"), max_size=40)))
def test_documents_against_bytes(text):
    aligner = alignment._aligner(alignment.BYTE_TOKENIZER, alignment.PIECE_TOKENIZER)
    assert aligner.by_parts
    a, b, groups, links = brute_document(text)
    n_a, n_b, n_groups, got, linked = aligner.align(text)
    pairs = Counter((int(p) >> 32, int(p) & 0xFFFFFFFF) for p in np.frombuffer(linked, "<i8"))
    assert (n_a, n_b, got, pairs) == (len(a), len(b), groups, links)
    assert n_groups == groups.count(";") + bool(groups) and aligner.aligned_part(text) == (n_a, n_b, n_groups, got, linked)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=30))
def test_ranks_are_the_tokenizer(text):
    tokens = alignment._aligner(alignment.BYTE_TOKENIZER, alignment.PIECE_TOKENIZER).a
    assert tokens.ranks.encode_ordinary(" " + text) == A.encode(" " + text, add_special_tokens=False).ids


def test_link_table(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c")], "doc_id long, text string")
    table = alignment.link_table(alignment.align(docs)).collect()
    total = sum((brute_document(t)[3] for t in ("a b a", "a c")), Counter())
    assert {(r.a_id, r.b_id): r.links for r in table} == dict(total) and all(r.best for r in table)
