import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer(bpe.default_vocabulary())


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def joined(own, text, leaf, piece):
    """The distributed path with small leaves."""
    old, bpe.PIECE = bpe.PIECE, piece
    try:
        out = []
        for k, part in own.parts(text):
            out += [k] if k is not None else own.joined([(w, own.leaf(w, b)) for w, b in own.leaves(part, leaf)])
        return out
    finally:
        bpe.PIECE = old


ALPHABET = st.one_of(st.sampled_from("ab the1290 \n\t'’s.,!éß漢😀"), st.characters(codec="utf-8"))


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=200), st.sampled_from([8, 20, 64]), st.sampled_from([4, 9, 32]))
def test_leaves_join_to_what_the_library_gives(library, own, text, leaf, piece):
    assert joined(own, text, leaf, piece) == ids(library, text) == own.encode(text)


def test_unsplit_text_and_special_tokens(library, own):
    rng = random.Random(1)
    texts = ["a" * 9000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), "漢字かな" * 3000, "x<|endoftext|>y" * 9, "<|endoftext|>", "word " * 9000, "ab" * 5000 + " " * 5000 + "c"]
    for t in texts:
        assert own.encode(t) == ids(library, t)
        assert joined(own, t, 512, 64) == ids(library, t)


def test_rows(spark, library):
    long = "The quick brown fox, 12 of them. " * 90 + "q" * 700
    rows = [(1, "Hello <|endoftext|> there", 5), (2, None, 6), (3, "", 7), (4, long, 8), (5, long, 9), (5, long, 9), (None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    got = bpe.bpe_decode(bpe.bpe_encode(docs, leaf=256)).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in got) == sorted((a or 0, b or "") for a, b, _ in rows)
    for r in got:
        want = ids(library, r["text"] or "")
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
    assert bpe.bpe_encode(docs.limit(0)).count() == 0
