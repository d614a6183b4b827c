import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoline.llm import packing


@pytest.fixture(scope="module")
def words():
    return packing._words(None)


def brute(words, text):
    ids = words.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBé'sdm  \n\t́  \x1c9<|>endoftextñ你ΑΣ.,!-"), max_size=60))
def test_ids_by_parts_are_the_tokenizers_ids(text):
    w = packing._words(None)
    assert packing.token_bytes(text, w) == brute(w, text)


def test_special_tokens_in_texts(words):
    for text in ("a<|endoftext|>b c", "<|startoftext|>", "<|ENDOFTEXT|>", "Hello, WORLD. It's", "a.b, c,. D_,",
                 "\u01c5, \u0130. \u03a3,", "J\u030c, E\u0301.", "", None, " \n "):
        assert packing.token_bytes(text, words) == brute(words, text)


def check(rows, texts, words, max_tokens):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids, at = brute(words, text), 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.length > 0
            part = ids[4 * r.start:4 * (r.start + r.length)]
            assert zlib.crc32(part) == r.ids_crc32
            at += r.length
        assert at == len(ids) // 4
    padding = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_tokens
        padding += 0 if at & (at - 1) == 0 else max_tokens - at
    return padding


def test_whole_pack(spark, words):
    texts = {i: " ".join(f"word{j % 7} the" for j in range((i * 37) % 400)) for i in range(200)}
    texts |= {1000: None, 1001: "", 1002: "long text here " * 5000, 1003: "same", 1004: "same"}
    docs = spark.createDataFrame([(k, v, "x", "clash") for k, v in texts.items()],
                                 "doc_id long, text string, ids string, start string").repartition(3)
    assert check(packing.digests(packing.pack(docs, block=4)).collect(), texts, words, 2048) == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_descending_pieces_go_to_the_cheapest_sequence():
    p = packing.Packer(8, 8.0, 10, 0)
    for k, n in enumerate((5, 3, 4, 4)):
        p.add(k, b"\0\0\0\0" * n)
    p._pack()
    assert sorted(tuple(sorted(r[0] for r in p.done if r[5] == s)) for s in (0, 1)) == [(0, 1), (2, 3)]
