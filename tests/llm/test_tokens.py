import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import tokens

PATH = os.path.join(tokens.VOCABULARIES, tokens.VOCABULARY)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
ODD = ["", " ", "  a  \n\n b", "​ x y", "<|endoftext|> hi", "don't I'LL 's", "a" * 300, " " * 300, "日本語テキスト" * 9, "é" * 9, "𝔘𝔫𝔦 👩‍🌾", "\x00\x01\x85 ", "①②½Ⅷ", "ab cd" * 400]


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(PATH)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_against_the_library(text):
    import tiktoken

    e = tokens.encoder(PATH)
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=e.bpe.ranks, special_tokens={})
    assert e.encode(text) == own.encode_ordinary(text)


def test_odd_texts(enc, reference):
    for s in ODD:
        assert enc.encode(s) == reference(s), s[:40]


def test_prefix_tables_grow_exactly(enc):
    whole = tokens.PrefixTable(enc.bpe, b"")
    for b in "unbelievably".encode():
        whole.append(bytes([b]))
        assert whole.ids() == tokens.PrefixTable(enc.bpe, whole.data).ids()
        assert len(whole.last) == len(whole.data)


def test_edits_re_encode_only_nearby(enc):
    rng = random.Random(3)
    t = tokens.EncodedText(enc, "The quick brown fox isn't  here.\n\nReally? Yes " * 20)
    for _ in range(200):
        a = rng.randrange(len(t.text) + 1)
        b = min(len(t.text), a + rng.choice([0, 0, 1, 4, 20]))
        redone = t.replace(a, b, rng.choice(["", " ", "\n", "x", "'s", " the", "é", "12"]))
        assert t.ids() == enc.encode(t.text)
        assert redone < 30
    t.append(" more")
    assert t.ids() == enc.encode(t.text)


def test_operator(spark, reference):
    rows = [(k, s) for k, s in enumerate([None, *ODD])] + [(0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'clash' as ids", "1 as n_tokens")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {k: (reference(s) if s else []) for k, s in rows}
    assert {r.doc_id: r.n_tokens for r in tokens.count(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.limit(0)).count() == 0
