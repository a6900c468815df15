from __future__ import annotations

import random

import public_tokenizers
import pytest

from millrace.llm import token_count as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b ", " ", "\n", "!", "é", "日本", "🙂", "<|endoftext|>", "'s", "   ", "12", "<|endo", "\x85", "\x1c", "\xa0", "ª", "²"]


@pytest.fixture(scope="module")
def tok():
    return tc.tokenizer(PATH, public_tokenizers.PATTERN)


def _texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    out = []
    for k in range(n):
        x = "".join(r.choice(PIECES) for _ in range(r.randint(0, 300)))
        out.append(r.choice("a !") * r.randint(0, 900) + x if k % 3 == 0 else x)
    return out


def test_splicing_gives_the_whole_texts_count(tok):
    r = random.Random(5)
    for text in _texts(600, 1):
        got = tc.spliced_count(tok.encode, text, r.randint(40, 90), r.randint(1, 40), tok.guard)
        assert got == tok.fast([text])[0]


def test_a_text_without_boundaries_widens_to_the_whole(tok):
    assert tc.spliced_count(tok.encode, "a" * 9000, 500, 20, tok.guard) == tok.fast(["a" * 9000])[0]


def test_shared_pre_tokens_give_the_library_s_counts(tok):
    texts = ["".join(c for c in t if c < "ɐ").replace("<|", "<") for t in _texts(300, 2)] + _texts(100, 3)
    assert tc.counts(texts, tok, 200, 50) == tok.fast(texts)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    tok = tc.tokenizer(public_tokenizers.path(name))
    texts = ["Hello there, world.", "", "née 12 " * 50]
    assert tc.counts(texts, tok, 10_000, 100) == tok.fast(texts)


def test_nulls_empty_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "x")], "doc_id long, text string, N_Tokens string")
    rows = tc.count_tokens(df, PATH, limit=1).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in rows] == [(0, 0, False), (0, 0, False), (11, 2, True), (11, 2, True)]
    assert tc.count_tokens(df.where("false"), PATH).count() == 0
