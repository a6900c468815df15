"""The registered queries over whole tables, against libraries and plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import bpe, toxicity
from millrace.llm import queries as q
from oracle import same


def _texts(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_op1_sizes_checksums_slots_and_balance(spark, small):
    texts, rows = _texts(spark, small), q.op1_histogram_sort(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards = defaultdict(list)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        shards[r.shard].append(r)
    assert set(shards) <= set(range(40))
    for each in shards.values():
        assert sorted(r.slot for r in each) == list(range(len(each)))
    # no cut could be nearer than half a document to its target
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    sums = [sum(r.size for r in shards[k]) for k in range(40)]
    assert all(abs(sum(sums[:k]) - total * k / 40) <= largest / 2 + 0.002 * total / 40 + 1 for k in range(41))
    # equal texts are neighbours
    order = [hashlib.md5(texts[r.doc_id].encode()).digest() for k in range(40) for r in sorted(shards[k], key=lambda r: r.slot)]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) == len(set(order)) - 1


def test_op3_counts_as_the_library(spark, small):
    lib = Tokenizer.from_file(public_tokenizers.path(q.BPE_JSON))
    texts = _texts(spark, small)
    for r in q.op3_token_counts(spark, small).collect():
        text = texts.pop(r.doc_id)
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert not texts


def test_op4_matches_sql(spark, small):
    same(q.op4_warc_round_trip(spark, small), q.ORACLE["op4_warc_round_trip"], small)


def test_op8_encodes_as_the_library(spark, small):
    ranks = bpe.load_ranks(public_tokenizers.path(q.BPE_RANKS))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = _texts(spark, small)
    for r in q.op8_byte_bpe(spark, small).collect():
        text = texts.pop(r.doc_id)
        ids = lib.encode_ordinary(text)
        said = " ".join(map(str, ids))
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not texts


def test_op7_tells_toxic_documents_it_has_not_seen(spark, tmp_path):
    """Labels of even documents to learn from; those of odd ones, of other texts, to be told."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("doc_id % 2 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in q.op7_toxicity_chain(spark, str(tmp_path)).collect()}
    texts = _texts(spark, folder)
    assert sorted(got) == sorted(texts)
    chain = toxicity.fit(docs, labels.where("doc_id % 2 = 0"), q.TOXIC_CATEGORIES)
    for doc in sorted(texts)[::37]:
        low, toxic = chain.probabilities(texts[doc])
        assert abs(got[doc].low_quality - low) < 1e-9 and abs(got[doc].toxicity - toxic) < 1e-9
        assert got[doc].toxic == (toxic >= chain.cuts["toxic"])
    rows = labels.collect()
    learnt = {texts[r.doc_id] for r in rows if r.doc_id % 2 == 0}
    odd = [r for r in rows if r.doc_id % 2 and texts[r.doc_id] not in learnt]
    caught = sum(got[r.doc_id].toxic for r in odd if r.toxic) / sum(r.toxic for r in odd)
    wrong = sum(got[r.doc_id].toxic for r in odd if not r.toxic) / sum(1 - r.toxic for r in odd)
    assert caught >= 0.88 and wrong <= 0.03  # some labels are wrong
