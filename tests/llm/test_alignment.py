from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from millrace.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    tok = tokenizers.Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


def grouped(text, libraries) -> list[tuple[list[int], list[int]]]:
    """Groups of a whole text, by merging the ends of both libraries' tokens."""
    if not text:
        return []
    tok, sp = libraries
    alphabet = alignment.byte_alphabet()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    said_a = [bytes(alphabet[c] for c in tok.id_to_token(x)) for x in a]
    said_b = [bytes([int(sp.id_to_piece(x)[3:5], 16)]) if sp.is_byte(x) else sp.id_to_piece(x).replace("▁", " ").encode() for x in b]
    if not b"".join(said_a) == b"".join(said_b) == (" " + text).encode():
        return []
    out, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            out[-1][0].append(a[i])
            at_a, i = at_a + len(said_a[i]), i + 1
        else:
            out[-1][1].append(b[j])
            at_b, j = at_b + len(said_b[j]), j + 1
        if at_a == at_b:
            out.append(([], []))
    return out[:-1]


def brute(texts: dict, libraries) -> set[tuple]:
    every = {k: grouped(t, libraries) for k, t in texts.items()}
    links = {k: Counter((x, y) for xs, ys in g for x in xs for y in ys) for k, g in every.items()}
    count = Counter(p for c in links.values() for p in c)
    most: dict[int, int] = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = set()
    for k, g in every.items():
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        c = links[k]
        out.add(
            (
                k, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]),
                sum(n * count[p] for p, n in c.items()), sha256(said.encode()).hexdigest() if g else "",
            )
        )
    return out


ODD = [
    None, "", " ", "  ", "   x", "a  b   c    d", "tail ", "tail  ", "a\n b\n  c\r\n   d\t e", "foo();\r\n  bar", "<|endoftext|> <s></s><unk> <0x41>", "a▁b", "▁",
    "日本語のテキスト 한국어 😀👩‍👩‍👧", "x" * 3000, "é ́ ﬁ 　  y\x1c z\x85 \x00w", "0123456789 " * 50, "﻿bom", "it's we'll  'tis",
]


def test_odd_texts_match_whole_text_encoding(spark, libraries):
    rnd = random.Random(2)
    texts = dict(enumerate(ODD))
    texts |= {100 + i: "".join(rnd.choice(" '\n\r\tabSTst.1;)é▁日Σ　\x1c") for _ in range(rnd.randrange(1, 120))) for i in range(200)}
    texts |= {1000 + i: "a copy of many" for i in range(50)}
    df = spark.createDataFrame([(k, t, 3, "z") for k, t in texts.items()], "doc_id long, text string, n_a int, `GROUPS_SHA256` string").repartition(4)
    want = brute(texts, libraries)
    for head in (alignment.HEAD, 40, 0):
        out = alignment.align(df, A, B, head=head)
        assert out.columns == ["doc_id", "text", *alignment.COUNTS, "groups_sha256"]
        assert {(r.doc_id, *(r[c] for c in alignment.COUNTS), r.groups_sha256) for r in out.collect()} == want
    assert alignment.align(df.limit(0), A, B).count() == 0
    said = {r.doc_id: r.said for r in alignment.align(df, A, B, groups="said").collect()}
    assert said[1] == "" and said[16].count(";") > 50


def test_workers_that_forget_count_the_same(spark, libraries, monkeypatch):
    own = alignment.Aligner(alignment.Pair(A, B))
    texts = [t for t in ODD if t] * 2
    first = own.linked(own(texts))
    assert len(set(first[0].tolist())) > 10
    monkeypatch.setattr(alignment, "CHUNKS", 1)
    assert own.full()
    own.forget()
    again = own.linked(own(texts))
    assert all((x == y).all() for x, y in zip(first, again, strict=True))


def test_chunks_in_runs_have_the_ids_of_lone_ones(libraries):
    own, given = alignment.Pair(A, B), []
    whole = own.whole
    own.whole = lambda texts: given.extend(texts) or whole(texts)
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(" '\n\tabSTst.1;)é▁日Σ　\x1c\u0301") for _ in range(rnd.randrange(1, 60))) for _ in range(400)] + [t for t in ODD if t]
    chunks = [c for t in texts for c in alignment.CHUNK.findall(" " + t)] + [" " + t for t in texts]
    assert own.a(chunks) == [libraries[0].encode(c, add_special_tokens=False).ids for c in chunks]
    given.clear()
    chunks = [f" word{i}" for i in range(640)]
    assert own.a(chunks) == whole(chunks) and len(given) == 10
    assert own.a([]) == []


def test_query(spark, small, libraries):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.QUERIES["op13_alignment"](spark, small).collect()
    assert {tuple(r) for r in got} == brute(texts, libraries)
