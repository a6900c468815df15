from __future__ import annotations

import re
import threading
from collections import Counter

import corpus_pipeline as cp
import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bpe, common, toxicity
from millrace.llm.queries import ORACLE, TOXIC_CATEGORIES
from test_ngram_join import _brute
from test_pii import _base


@pytest.fixture(scope="module")
def outputs(spark, small):
    """Each stage's output on its predecessor's, documents first."""
    out = [spark.read.parquet(f"{small}/documents.parquet")]
    for k, (_, stage) in enumerate(cp.STAGES):
        out.append(cp.materialise(stage(spark, out[-1], small), f"test-{k}"))
    return out


def _rows(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_columns(outputs):
    assert all(o.columns == outputs[0].columns for o in outputs[:-1])
    assert outputs[-1].columns == [*outputs[0].columns, "ids"]


def test_toxic_documents_go(spark, small, outputs):
    chain = toxicity.fit(outputs[0], spark.read.parquet(f"{small}/labels.parquet"), TOXIC_CATEGORIES)
    want = [r for r in _rows(outputs[0]) if chain.probabilities(r[1])[1] < chain.cuts["toxic"]]
    assert _rows(outputs[1]) == want and len(want) < outputs[0].count()


def test_one_document_of_each_group_stays(outputs):
    before = _rows(outputs[1])
    groups = {doc: least for doc, _, least in _brute([(r[0], r[1]) for r in before], 80, 100, 5)}
    assert _rows(outputs[2]) == [r for r in before if groups[r[0]] == r[0]]


def test_personal_data_is_replaced(outputs):
    before, after = _rows(outputs[2]), {r[0]: r for r in _rows(outputs[3])}
    assert len(after) == len(before)
    for doc, text, lang, source, _ in before:
        secrets = [("secret", m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', text)]
        spans = sorted((a, b, k) for k, a, b in [*_base(text), *secrets])
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        out = "".join(out) + text[at:]
        # of the spans beyond the base kinds, only secrets occur in these tables
        assert after[doc] == (doc, out, lang, source, len(out))


def test_documents_are_taken_as_often_as_the_mix_says(outputs):
    documents = outputs[3].toPandas()  # noqa: F841  DuckDB reads it by its name
    taken = duckdb.sql(ORACLE["op5_pareto_mix"]).fetchall()
    want = Counter({doc: t // size for doc, size, _, _, t in taken if size and t})
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in _rows(outputs[3])}
    got = Counter(r[0] for r in _rows(outputs[4]) if words[r[0]])
    assert got == want and set(map(tuple, _rows(outputs[4]))) <= set(map(tuple, _rows(outputs[3])))


def test_texts_are_encoded(outputs):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = outputs[5].collect()
    assert len(rows) == outputs[4].count() and all(r.ids == enc.encode_ordinary(r.text) for r in rows)


def test_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b c d e f", "en", None, 11), (1, "", "", "", 0), (1, "", "", "", 0)], docs.schema)
    for rows in (odd, odd.where("false")):
        for _, stage in cp.STAGES:
            rows = cp.materialise(stage(spark, rows, small), "odd")
        rows.count()


def test_further_columns_pass_and_settings_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    names = ["toxic", "low_quality", "target", "taken", "copies", "source_size", "candidates", "spans", "n_ip", "__size", "words", "rest", "row", "a.b"]
    rows = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names]).withColumn("ids", F.lit(1))
    before = {k: spark.conf.get(k) for k in cp.BATCH_ROWS}
    for _, stage in cp.STAGES:
        columns = rows.columns
        rows = cp.materialise(stage(spark, rows, small), "clash")
        assert sorted(rows.columns) == sorted(columns)
    assert {k: spark.conf.get(k) for k in cp.BATCH_ROWS} == before
    found = rows.collect()
    assert found and all(r[n] == f"{n}-{r.doc_id}" for r in found for n in names) and all(isinstance(r.ids, list) for r in found)


def test_map_and_variant_columns_pass(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    rows = docs.select("*", F.create_map(F.lit("k"), F.col("doc_id")).alias("m"), F.parse_json(F.concat(F.lit('{"a": '), F.col("doc_id"), F.lit("}"))).alias("v"))
    for _, stage in cp.STAGES:
        rows = cp.materialise(stage(spark, rows, small), "kinds")
    found = rows.selectExpr("doc_id", "m['k'] AS k", "variant_get(v, '$.a', 'long') AS a").collect()
    assert found and all(r.k == r.a == r.doc_id for r in found)


def test_scopes_of_two_threads_stay_apart(spark):
    """A path made in one thread's scope is never deleted by the other's."""
    inside, made = threading.Barrier(2), {}

    def run(name):
        with common.scope(name):
            inside.wait()
            made[name] = common.scratch_path(spark, name)
            inside.wait()

    both = [threading.Thread(target=run, args=(n,)) for n in ("a", "b")]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert all(common._scopes[n] == [made[n]] for n in "ab")
    for n in "ab":
        common.release(spark, n)
