from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from millrace.llm import merkle, queries
from oracle import same


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def up(nodes: list[str], fanout: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute(rows: list[tuple], fanout: int) -> list[tuple]:
    """(id, leaf, subroot, root, proof, folded root) of (id, source, text) rows; every third id is lower-cased."""
    trees: dict = {}
    for i, s, t in rows:
        trees.setdefault(s, []).append((i, h(field(i), field(s), field(t)), h(field(i), field(s), field(t and t.lower()))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: up([x[1] for x in sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for s in order}
    above = up([levels[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for pos, (i, leaf, seen) in enumerate(sorted(trees[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            cur, proof = seen if i is not None and i % 3 == 0 else leaf, ""
            for at, tree in ((pos, levels[s]), (k, above)):
                for level in tree[:-1]:
                    a = at // fanout * fanout
                    left, right = "".join(level[a:at]), "".join(level[at + 1 : a + fanout])
                    proof, cur, at = proof + left + right, h(left, cur, right), at // fanout
            out.append((i, leaf, levels[s][-1][0], above[-1][0], h(proof), cur))
    return out


SCHEMA = "id long, s string, t string"


def made(spark, rows, fanout, levels, **more):
    df = spark.createDataFrame(rows, SCHEMA + ", node int, `tree` string").repartition(5) if len(rows[0]) > 3 else spark.createDataFrame(rows, SCHEMA)
    return merkle.manifest(df, ["id", "s", "t"], "s", "id", (F.coalesce(F.col("id") % 3 == 0, F.lit(False)), {"t": F.lower("t")}), fanout, levels, **more)


@pytest.mark.parametrize(("fanout", "levels"), [(2, 1), (3, 2), (16, 3)])
def test_same_as_brute_force(spark, fanout, levels):
    rows = [(i, "hot" if i % 3 else f"é{i % 23}", f"Text {i % 40}") for i in range(150)]
    rows += [(7, None, "A"), (None, None, "B"), (None, "hot", None), (None, "hot", ""), (5, "", "same"), (5, "", "same"), (5, "", "other"), (9, "lone", "x" * 100_000)]
    got = made(spark, [(*r, 1, "x") for r in rows], fanout, levels).collect()
    assert sorted(map(tuple, (r[:6] for r in got)), key=repr) == sorted(brute(rows, fanout), key=repr)
    assert all(r.verified == (r.folded_root == r.root) for r in got) and {r.verified for r in got} == {True, False}


def test_paths_lead_to_the_root(spark):
    rows = [(i, f"s{i % 7}", f"Text {i}") for i in range(60)]
    for r in made(spark, rows, 4, 1, paths=True).collect():
        assert merkle.fold(r.leaf, r.path) == r.root
        assert sha256("".join(x.others for x in r.path).encode()).hexdigest() == r.proof_sha256


def test_rows_left_as_they_were_are_folded_too(spark):
    nodes = [h(str(i)) for i in range(5)]
    tree, other = up(nodes, 4), h("another subroot")
    leaves = spark.createDataFrame([("s", i, 5, i, bytes.fromhex(x), None) for i, x in enumerate(nodes)], "tree string, pos long, n long, id long, node binary, seen binary")
    for root, whole in ((h(tree[-1][0], other), True), (h(tree[-1][0], "a root that the siblings don't lead to"), False)):
        above = spark.createDataFrame([("s", 0, [(0, other)], tree[-1][0], root)], f"tree string, pos long, path {merkle.PATH}, subroot string, root string")
        for paths in (False, True):
            got = merkle._proven(leaves, above, "id", 4, 2, paths).collect()
            assert len(got) == 5 and {(r.folded_root, r.verified) for r in got} == {(h(tree[-1][0], other), whole)}


def test_one_row_and_none(spark):
    (r,) = made(spark, [(1, "a", "b")], 16, 3).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == h("") and r.verified
    assert made(spark, [(1, "a", "b")], 16, 3).where("id > 1").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty, ["id", "t"], "s", "id").count() == 0


def test_equal_rows_are_spread_over_blocks(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("id"), F.lit("s").alias("s"), F.lit("copy").alias("t"))
    got = merkle.manifest(rows, ["id", "t"], "s", "id", fanout=4, levels=2)
    assert got.count() == 3000 and got.select("root").distinct().count() == 1
    want = up([h("-", field("copy"))] * 3000, 4)[-1][0]
    assert got.first().root == want


def test_query_matches_its_oracle(spark, small):
    same(queries.QUERIES["op11_merkle_manifest"](spark, small), queries.ORACLE["op11_merkle_manifest"], small)
    r = queries.QUERIES["op11_merkle_manifest"](spark, small).where("NOT verified").first()
    assert crc32(str(r.doc_id).encode()) % 5 == 0
