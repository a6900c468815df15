from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from millrace.llm import packing, queries

VOCAB = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCAB)


def test_first_fit_is_that_of_a_scan():
    rnd = random.Random(3)
    for n in (1, 2, 5, 64, 333):
        sizes = sorted((rnd.randrange(1, 101) for _ in range(n)), reverse=True)
        left, want = [], []
        for s in sizes:
            b = next((i for i, x in enumerate(left) if x >= s), len(left))
            left += [100] * (b == len(left))
            left[b] -= s
            want.append(b)
        assert packing.first_fit(sizes, 100) == want
    assert packing.first_fit([], 100) == []


@pytest.mark.parametrize("least", [1, 8])
def test_pieces_cover_each_item_once(least):
    rnd = random.Random(5)
    for n in (0, 1, 2, 7, 200):
        sizes = sorted((rnd.randrange(1, 128) for _ in range(n)), reverse=True)
        made = packing.packed(sizes, 128, least)
        for item, size in enumerate(sizes):
            own = sorted((a, b) for s in made for i, a, b in s if i == item)
            assert sum(b for _, b in own) == size and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False))
        for s in made:
            fill = sum(x[2] for x in s)
            assert 128 - least < fill <= 128 or fill & (fill - 1) == 0


def test_ids_are_the_librarys(library):
    texts = [
        "", " ", "It's  here\nand there\t's <|endoftext|> <|startoftext|>x", "a ́b é Σας ΣΑΣ İ ﬁ  x y\x1cz\x85", "日本語 テキスト 한국어", "x" * 5000,
        " leading", "trailing ", "1234 5.6%…", " ".join("word%d" % i for i in range(3000)),
    ]
    rnd = random.Random(1)
    texts += ["".join(rnd.choice("'sTrevELMdl.é;ÀßµªÿÖ\xad1<|>") for _ in range(12)) for _ in range(500)] + [chr(c) * 2 + "a" + chr(c) for c in range(1, 600)]
    texts += ["".join(rnd.choice(" '\n\tabSTst.1́é<|>Σ　") for _ in range(200)) for _ in range(300)]
    own = packing.encoder(VOCAB)
    assert isinstance(own.ids, packing.ChunkIds) and isinstance(own.ids.encode, packing.WordIds)
    window, packing.WINDOW = packing.WINDOW, 50
    try:
        got = own.ids(texts)
    finally:
        packing.WINDOW = window
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_words_are_encoded_in_runs(library):
    own, given = packing.encoder(VOCAB).ids.encode, []
    words = packing.WordIds(lambda texts: given.extend(texts) or [e.ids for e in library.encode_batch(texts, add_special_tokens=False)], own.find.__self__.pattern, own.ends)
    chunks = ["", *(f"Word{'abcdefghij'[i % 10] * (i // 10)}'s,\r\nnext" for i in range(1000)), "Σας", "", "<|endoftext|>x", "</w>", "a</w>b"]
    want = [library.encode(c, add_special_tokens=False).ids for c in chunks]
    for ends, calls in ((own.ends, 15), (np.zeros_like(own.ends), 1100)):  # without ends, each word is a call's text of its own
        words._forget()
        words.ends = ends
        given.clear()
        size, ids = words(chunks)
        assert (size.tolist(), ids.tolist()) == flatly(want)
        assert len(given) <= calls
        size, ids = words(chunks[:3] + chunks[-2:])
        assert (size.tolist(), ids.tolist()) == flatly(want[:3] + want[-2:])


def flatly(want):
    return [len(x) for x in want], [i for x in want for i in x]


def check(rows, texts: dict, library, length: int, least: int = packing.LEAST):
    """Pieces against the library's ids; ``texts``: key to text."""
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, own in ids.items():
        at = 0
        for r in sorted(by_doc.pop(k), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(own)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
            at += r.length
        assert at == len(own)
    assert not by_doc
    padding = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        if at & (at - 1):
            assert length - at < least
            padding += length - at
    return padding / max(1, sum(map(len, ids.values())))


def test_query(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_packing"](spark, small).collect()
    assert check(rows, texts, library, 2048) < 0.004


def test_odd_rows(spark, library):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = {1: None, 2: "", 3: long, 4: "same text", 5: "same text", 6: "x" * 3000, None: "no id"}
    df = spark.createDataFrame([(k, t, 7, "y") for k, t in texts.items()], "doc_id long, text string, start int, LENGTH string")
    rows = packing.pack(df, VOCAB, length=64, group_docs=3, ids=True).collect()
    check(rows, texts, library, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    copies = spark.createDataFrame([(None, "one of many copies")] * 500, "doc_id long, text string").repartition(3)
    got = packing.pack(copies, VOCAB, length=64, group_docs=50)
    assert got.selectExpr("sum(length)").first()[0] == 500 * (len(library.encode("one of many copies", add_special_tokens=False).ids) + 1)
    assert got.selectExpr("count(distinct sequence_id >> 32)").first()[0] == 10
    assert packing.pack(df.limit(0), VOCAB).count() == 0
