from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ngram_join as nj
from millrace.llm.components import components
from millrace.llm.queries import ORACLE, op10_ngram_jaccard
from oracle import same


def _set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def _brute(rows, num, den, n):
    sets = [_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i), None) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def _corpus(seed, groups, spread):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 4)))
    common = [word() for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [word() for _ in range(r.randint(2, 120))]
        if g % 4 == 0:
            base = common + base[:8]
        for _ in range(r.randint(1, spread)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            rows.append((len(rows) * 7 % 1009, r.choice([" ", "\n", "\t "]).join(t).upper() if r.random() < 0.3 else " ".join(t)))
    return rows


def test_shingle_sets_match_python():
    r = random.Random(3)
    texts = ["".join(r.choice("aAbB é\n\t\x0b\x1c ß") for _ in range(r.randint(0, 40))) for _ in range(800)] + ["", " ", "a", "a b", "a b c"]
    data = [t.encode() for t in texts]
    bounds = np.cumsum([0] + [len(x) for x in data])
    for n in (1, 3, 5):
        hashes, at = nj.shingle_sets(np.frombuffer(b"".join(data), np.uint8), bounds, n)
        sets = [hashes[a:b] for a, b in zip(at, at[1:], strict=False)]
        assert [len(s) for s in sets] == [len(_set(t, n)) for t in texts]
        for i in range(0, 150):
            for j in range(i):
                assert len(np.intersect1d(sets[i], sets[j])) == len(_set(texts[i], n) & _set(texts[j], n))


def _chain():
    words = [f"w{i}" for i in range(400)]
    return [(10_100 - k, " ".join(words[2 * k : 2 * k + 120])) for k in range(60)]


def _odd():
    long = "word " * 3000 + "end"
    return [
        (5005, None), (5004, ""), (5003, " \n"), (5009, "a9 b9"), (5002, "A9  b9"), (None, "a9 b9"), (5007, "a9 b9 c9 d9 e9 f9"), (5007, "a9 b9 c9 d9 e9 f9"),
        (None, "q9 r9 s9 t9"), (None, "q9 r9 s9 t9"), (5008, long), (5001, long),
    ]


@pytest.mark.parametrize("num,n,seed", [(90, 3, 1), (80, 5, 2)])
def test_components_match_brute_force(spark, num, n, seed):
    rows = _corpus(seed, 40, 9) + _chain() + _odd()
    got = nj.similar(spark.createDataFrame(rows, "doc_id long, text string"), num, 100, n)
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(rows, num, 100, n)


def test_groups_of_several_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("SMALL", 2), ("HOT", 0.0), ("LIKELY", 1)):
        monkeypatch.setattr(nj, name, value)
    rows = _corpus(7, 25, 14)
    got = nj.similar(spark.createDataFrame(rows, "doc_id long, text string"), 80, 100, 3)
    assert sorted(map(tuple, got.collect()), key=repr) == _brute(rows, 80, 100, 3)


def test_an_empty_table(spark):
    empty = nj.similar(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 202), (202, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 203), 200)}


def test_matches_sql(spark, small):
    same(op10_ngram_jaccard(spark, small), ORACLE["op10_ngram_jaccard"], small)


def test_one_of_each_group_stays(spark):
    long = [f"w{i}" for i in range(100)]
    rows = [
        (5, "a b c d"), (2, "A b c d"), (2, "A b c d"), (None, "a b c d"), (9, "q"), (9, "other words here"), (7, None), (None, None),
        # a repeated id is judged by its text
        (21, "a b c d e f g"), (25, "a b c d e f g"), (25, "wholly other words stand here now"),
        # linked rows of one id leave one
        (33, " ".join(long)), (33, " ".join(long[1:])), (33, "unlike them"), (38, " ".join(long)),
    ]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `row.id` int")
    out = nj.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    sure = [(2, "A b c d"), (None, "a b c d"), (9, "q"), (9, "other words here"), (7, None), (None, None), rows[8], rows[10], (33, "unlike them")]
    assert len(kept) == len(sure) + 1 and set(sure) <= set(kept) and {k for k in kept if k not in sure} <= set(rows[11:13])


def test_signatures_never_exceed_the_difference():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = sorted((np.sort(r.choice(pool, int(k), replace=False)) for k in r.integers(1, 700, 60)), key=len)
    v = nj._Signatures(np.array([nj._signature(x) for x in sets], object))
    for a in range(60):
        got = v.differ(a, np.arange(60))
        want = [len(np.setxor1d(sets[a], x)) for x in sets]
        assert (got <= want).all() and got[a] == 0


def test_positional_bound_never_drops_a_link(spark):
    r = random.Random(9)
    for num in (80, 90):
        t, rows = nj.Threshold(num, 100), []
        for _ in range(400):
            x = r.sample(range(60), r.randint(1, 50))
            y = sorted(set(x) ^ set(r.sample(range(60), r.randint(0, 6)))) or [1]
            x = sorted(x)
            p, q = x[: t.prefix(len(x))], y[: t.prefix(len(y))]
            common = sorted(set(p) & set(q))
            both = len(set(x) & set(y))
            if 100 * both >= num * len(set(x) | set(y)):
                assert common
                rows.append((len(common), len(x), len(y), x.index(common[-1]), y.index(common[-1])))
        df = spark.createDataFrame(rows, "n long, s int, u int, p int, q int")
        c = [F.col(k) for k in ("n", "s", "u", "p", "q")]
        assert rows and df.where(~(t.reachable(*c) & t.similar_sizes(c[1], c[2]))).count() == 0
