import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stemline.llm.bpe import VOCABULARY, Encoder, count_tokens, encode_corpus, load

ENCODER = Encoder(load())
PUBLIC = Tokenizer.from_file(VOCABULARY)
PUBLIC.encode_special_tokens = True


def public(text):
    return PUBLIC.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    ids, at = ENCODER.encode(texts)
    return [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]


CASES = ["", None, "<|endoftext|> is text", "a" * 5000, "ab" * 700, " \n\n  \t x", "é" * 300, "日本語" * 200, "\x00x", "x" * 161, "l" * 160, "  \r\n", "abcdefghij" * 30]


def test_fixed_cases():
    assert encoded(CASES) == [public(t) for t in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=200), max_size=5))
def test_any_text(texts):
    assert encoded(texts) == [public(t) for t in texts]


def test_heap_and_rounds_agree():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("aeirstnol") for _ in range(rnd.choice([90, 150, 170, 900]))) for _ in range(40)]
    assert encoded(words) == [public(w) for w in words]


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr("stemline.llm.bpe.KEPT", 3)
    e = Encoder(load())
    for t in ("one two three four five", "six two one", "five"):
        assert e.encode([t])[0].tolist() == public(t)


@pytest.mark.parametrize("rows", [[(i, t) for i, t in enumerate(CASES)], []])
def test_corpus(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    assert {r.doc_id: r.ids for r in encode_corpus(docs).collect()} == {i: public(t) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, ["doc_id"]).collect()} == {i: len(public(t)) for i, t in rows}


def test_very_long_texts():
    rnd = random.Random(4)
    long = [" ".join(rnd.choice(["cell", "Zelle", "細胞", "0x7f", "\n\n"]) for _ in range(120_000)), "q" * 60_000, "".join(rnd.choice("abcdefgh") for _ in range(60_000))]
    assert encoded(long) == [public(t) for t in long]
