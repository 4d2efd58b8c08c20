import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlode.llm import tokenize

pytestmark = pytest.mark.skipif(not os.path.exists(tokenize.TOKENIZER_DIR), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(f"{tokenize.TOKENIZER_DIR}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    return tokenize.ByteBpe(), reference


def same(pair, text):
    return pair[0].encode(text) == pair[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdehilnorst ,.'0123\n", max_size=80), st.text(alphabet="年营业收入，。的一了", max_size=60)))
def test_same_as_merging(pair, text):
    assert same(pair, text)


@pytest.mark.parametrize("text", ["", " ", "\n\n  \n", "<|endoftext|>", "a" * 5000, "哈" * 3000, "ab" * 4000 + "é", "it's we'll  x", "👩‍💼🇨🇳", "\x00\x01"])
def test_edges(pair, text):
    assert same(pair, text)


def test_table(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "hi there", 5), (3, "hi there", 5), (None, "x", 5)]
    got = tokenize.tokenize(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert [r["ids"] for r in got if r["doc_id"] in (1, 2)] == [[], []] and len(got) == 5
    assert tokenize.tokenize(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_round_trip(pair):
    by_id = {i: t for t, i in pair[0].ids.items()}
    text = "合同 contract №5 — naïve"
    assert "".join(by_id[i] for i in pair[0].encode(text)).encode("latin-1").decode() == text


def test_memos_are_small_and_change_nothing(monkeypatch):
    """Answers for pairs are kept under one number, and forgetting them gives the same ids."""
    from paperlode.llm import tokenize as own

    text = "The committee reviewed the amortisation schedule；投保人退保后终止 9l,2O0 naïve" * 3
    whole = own.ByteBpe()
    want = whole.encode(text)
    monkeypatch.setattr(own, "PAIRS_KEPT", 3)
    monkeypatch.setattr(own, "PIECES_KEPT", 0)
    short = own.ByteBpe()
    assert short.encode(text) == want and len(short.pair_ok) <= 3 and not short.pieces
    assert whole.pair_ok and all(isinstance(k, int) for k in whole.pair_ok)
