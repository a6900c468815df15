from __future__ import annotations

import random

import public_tokenizers
import tiktoken

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
OWN = bpe.Encoder(PATH, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OWN.vocab.ranks, special_tokens={})


def _texts() -> list[str]:
    r = random.Random(1)
    made = ["".join(r.choice("ab -\n!1é日🙂'stTHE") for _ in range(r.randint(0, 400))) for _ in range(500)]
    return [*made, "a" * 5000, "ab" * 3000, "!" * 4001, " " * 999, "\n \n" * 50, "日本" * 900, "", "<|endoftext|>"]


def test_one_by_one_and_in_a_batch():
    texts = _texts()
    want = [REFERENCE.encode_ordinary(t) for t in texts]
    assert [OWN.encode(t) for t in texts] == want
    fresh = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    numbers = fresh.learn(texts)
    ids, offsets = fresh.ids(numbers)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
    assert fresh.decimals(numbers) == [" ".join(map(str, w)) for w in want]


def test_scalar_queue_on_every_piece():
    for text in _texts():
        for piece in OWN.find(text):
            assert bpe.merge(piece.encode(), OWN.vocab.ranks) == REFERENCE.encode_ordinary(piece)


def test_rank_queue_order():
    q = bpe.RankQueue()
    for rank, at in ((300, 5), (7, 9), (300, 2), (70_000, 1), (7, 3)):
        q.push(rank, at)
    assert [q.pop() for _ in range(6)] == [(7, 3), (7, 9), (300, 2), (300, 5), (70_000, 1), None]


def test_round_trip_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "née 🙂\x00 x", 3), (3, "née 🙂\x00 x", 3)], "doc_id long, text string, IDS int")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in out] == ["", "", "née 🙂\x00 x", "née 🙂\x00 x"]
    both = bpe.encode(df, PATH, public_tokenizers.PATTERN, joined="said", decoded="decoded").collect()
    assert all(r.said == " ".join(map(str, r.ids)) and bytes(r.decoded).decode() == (r.text or "") for r in both)
    assert bpe.encode(df.where("false"), PATH, public_tokenizers.PATTERN).count() == 0
