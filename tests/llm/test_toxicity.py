from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import toxicity as tx
from millrace.llm.queries import TOXIC_CATEGORIES


def _texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7)))
    texts, low, toxic = [], [], []
    for _ in range(n):
        ws = [word() for _ in range(r.randint(5, 80))]
        low.append(r.random() < 0.2)
        toxic.append(r.random() < 0.15)
        if low[-1]:
            ws = [w + "%%%" for w in ws]
        if toxic[-1]:
            for _ in range(r.randint(1, 3)):
                ws[r.randrange(len(ws))] = r.choice(["zork", "blarg" + word(), "quux"])
        texts.append(" ".join(ws))
    return texts, np.array(low, float), np.array(toxic, float)


def test_held_out_accuracy():
    texts, low, toxic = _texts(3000, 1)
    chain = tx.fit_chain(texts[:2000], {"low": low[:2000], "toxic": toxic[:2000]}, np.arange(2000) % 3)
    p = np.array([chain.probabilities(t) for t in texts[2000:]])
    assert ((p[:, 0] >= 0.5) == low[2000:]).mean() > 0.97
    assert ((p[:, 1] >= 0.5) == toxic[2000:]).mean() > 0.98


def test_later_links_see_earlier_probabilities():
    texts, low, _ = _texts(1200, 2)
    chain = tx.fit_chain(texts, {"low": low, "again": low}, np.arange(1200) % 3)
    assert len(chain.links[0][2]) == tx.FORM and len(chain.links[1][2]) == tx.FORM + 1 and chain.links[1][2][-1] > 0


def test_unknown_labels_and_one_class():
    texts, low, _ = _texts(300, 3)
    some = np.where(np.arange(300) % 2 == 0, low, np.nan)
    chain = tx.fit_chain(texts, {"some": some, "never": np.zeros(300), "unknown": np.full(300, np.nan)}, np.arange(300) % 3)
    p = chain.probabilities("")
    assert len(p) == 3 and p[1] < 1e-6 and p[2] < 1e-6


def test_on_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumnRenamed("lang", "TOXIC")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 1), (10**9, 0, 1)], labels.schema).union(labels).union(labels)
    chain = tx.fit(docs, odd, TOXIC_CATEGORIES)
    out = tx.predict(docs.unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema)), chain)
    rows = out.collect()
    assert len(rows) == docs.count() + 1 and all(0 <= r.toxic <= 1 and 0 <= r.low_quality <= 1 for r in rows)
    none = tx.fit(docs, labels.where("false"), TOXIC_CATEGORIES)
    assert tx.predict(docs, none).where("toxic >= 0.5").count() == 0


def _dense_fit(x, y, toll, rounds=6000):
    """Plain proximal gradient on all features at once, without acceleration or a choice of words."""
    n, width = x.shape
    word = toll > 0
    w, b = np.zeros(width), np.log(y.mean() / (1 - y.mean()))
    step = 3.9 * n / np.linalg.norm(np.hstack((x, np.ones((n, 1)))), 2) ** 2
    ridge = np.where(word, tx.RIDGE, 1e-4)
    for _ in range(rounds):
        err = (1 / (1 + np.exp(-(x @ w + b))) - y) / n
        gw, b = x.T @ err, b - step * err.sum()
        w = np.where(word, 0, w - step * (gw + ridge * w)) + np.where(word, np.sign(w - step * gw) * np.maximum(0, np.abs(w - step * gw) - step * toll) / (1 + step * ridge), 0)
    return w, b


def test_all_features_are_fitted(monkeypatch):
    """The chain equals one that a plain fit of a dense matrix of all features gives."""
    monkeypatch.setattr(tx, "ROUNDS", 4000)
    monkeypatch.setattr(tx.fit_linear, "__defaults__", (4000,))
    texts, low, toxic = _texts(100, 5)
    texts = [" ".join(t.split()[:12]) for t in texts]
    labels, fold = {"low": low, "toxic": toxic}, np.arange(100) % tx.FOLDS
    chain = tx.fit_chain(texts, labels, fold)
    sparse, names = tx._counted(texts)
    x = np.zeros((100, sparse.width))
    x[sparse.row, sparse.at] = 1
    more = sparse.dense
    for j, y in enumerate(labels.values()):
        whole = np.hstack((x, more))

        def fit(keep):
            share = y[keep].mean()
            toll = tx.NOISE * np.sqrt((x[keep].sum(axis=0) + tx.SMOOTH) * share * (1 - share)) / keep.sum()
            return _dense_fit(whole[keep], y[keep], np.concatenate((toll, np.zeros(more.shape[1]))))

        out = np.zeros(100)
        for k in range(tx.FOLDS):
            w, b = fit(fold != k)
            out[fold == k] = 1 / (1 + np.exp(-(whole[fold == k] @ w + b)))
        w, b = fit(np.ones(100, bool))
        z = whole @ w + b
        own = np.array([chain.probabilities(t)[: j + 1] for t in texts])
        if j == 0:
            assert np.abs(own[:, 0] - 1 / (1 + np.exp(-z))).max() < 0.01
        _, words, dense, bias = chain.links[j]
        mine = np.array([words.get(n, 0.0) for n in names])
        assert np.abs(mine - w[: len(names)]).max() < 0.05 * max(1, np.abs(w).max())
        more = np.hstack((more, out[:, None]))


def test_odd_texts(spark, small):
    texts, low, toxic = _texts(300, 7)
    chain = tx.fit_chain(texts, {"low": low, "toxic": toxic}, np.arange(300) % 3)
    rows = [(1, "zork " * 300_000), (2, "zork"), (2, "zork"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = tx.predict(docs, chain).collect()
    assert len(out) == 5 and out[1].toxic == out[2].toxic and all(0 <= r.toxic <= 1 for r in out)
    assert tx.predict(docs.where("false"), chain).count() == 0


def test_an_id_with_many_texts_counts_once(spark, monkeypatch):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "two"), (3, "three")], docs.schema))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    seen, counted = [], tx._counted
    monkeypatch.setattr(tx, "_counted", lambda texts: counted(seen.append(t) or t for t in texts))
    tx.fit(docs, labels, {"toxic": "toxic"}, sample=2)
    assert 1 <= len(seen) <= 2
