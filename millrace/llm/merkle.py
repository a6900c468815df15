"""Merkle manifest of a dataset, with a proof for every row.

A row's leaf is the SHA-256 of its columns, each as byte count, colon and value, ``-`` where
null. Rows of one tree (a source) ascend by id; while several nodes remain, each run of
``fanout`` consecutive ones (the last may be shorter) becomes the hash of their lower-case hex
digests. What remains is the tree's subroot; subroots in order of their trees make the root
in the same way. A row's proof is the siblings of its path, level by level, up to the root.

Positions come from a prefix scan, so no task sorts a source. Nodes are grouped into aligned
blocks of ``fanout ** LEVELS``; a block is one contiguous numpy matrix of 64-byte hex rows, each
level of which is reshaped by fanout and hashed row by row, and siblings are found by index
arithmetic. Rounds of blocks go up until each tree has one node; the same blocks, taken from
the top, then hand each other the path above them, so a proof is never assembled by joins of
rows, and what a block gets from above doesn't grow with it. A hot source is many blocks.

Defined results: null ids come first; rows of one id are in order of their leaves, and equal
leaves are interchangeable; a null tree is a tree of its own, the first, others go by the UTF-8
bytes of their names; empty texts and nulls have different leaves; an empty table gives an
empty result; columns that aren't named are not looked at, so their names can't clash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.prefix import prefix_scan

from .common import discard, materialise

FANOUT, LEVELS = 16, 3
PATH = "array<struct<at:int,others:string>>"


def leaf(columns: dict[str, Column]) -> Column:
    """The leaf's digest in hex, from columns in order; they are cast to strings."""
    parts = []
    for c in columns.values():
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(leaf: str, path: list) -> str:
    """The root that a leaf's digest and its path (place in the run, digests of the others) lead to."""
    for at, others in path:
        leaf = sha256((others[: 64 * at] + leaf + others[64 * at :]).encode()).hexdigest()
    return leaf


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Binary digests as rows of 64 hex characters."""
    joined = b"".join(digests.to_pylist()).hex().encode()
    return np.frombuffer(joined, np.uint8).reshape(-1, 64)


def _levels(nodes: np.ndarray, n: int, fanout: int, most: int) -> list[np.ndarray]:
    """The block's matrices from its nodes up: until its tree (``n`` nodes at the first level) has one, ``most`` levels at most."""
    out = [nodes]
    while n > 1 and len(out) <= most:
        full = len(nodes) // fanout * fanout
        runs = [*np.ascontiguousarray(nodes[:full]).reshape(-1, 64 * fanout), *([nodes[full:]] if full < len(nodes) else [])]
        made = "".join(sha256(np.ascontiguousarray(r)).hexdigest() for r in runs)
        nodes = np.frombuffer(made.encode(), np.uint8).reshape(-1, 64)
        out.append(nodes)
        n = -(-n // fanout)
    return out


class _Siblings:
    """The other digests of each node's run in one level."""

    def __init__(self, nodes: np.ndarray, fanout: int) -> None:
        self.text, self.fanout, self.n = nodes.tobytes(), fanout, len(nodes)

    def __call__(self, i: int) -> tuple[bytes, bytes]:
        first = i - i % self.fanout
        return self.text[64 * first : 64 * i], self.text[64 * i + 64 : 64 * min(first + self.fanout, self.n)]


def _up(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, pos, n, node) of one round to those of the next."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t["n"][0].as_py()
        made = _levels(_matrix(t["node"]), n, fanout, levels)
        for _ in made[1:]:
            n = -(-n // fanout)
        top = bytes.fromhex(made[-1].tobytes().decode())
        return pa.table({"tree": t["tree"][:1], "pos": t["block"][:1], "n": pa.array([n], pa.int64()), "node": pa.array([top], pa.binary())})

    blocks = nodes.select("tree", "pos", "n", "node", F.floor(F.col("pos") / fanout**levels).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, n long, node binary")


def _down(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Each node's path, from that of its block: (tree, pos, path, subroot, root)."""

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        made = _levels(_matrix(t["node"]), t["n"][0].as_py(), fanout, levels)[:-1]
        near = [_Siblings(m, fanout) for m in made]
        tail = [(x["at"], x["others"]) for x in up["path"][0].as_py()]
        paths = []
        for i in range(t.num_rows):
            path, j = [], i
            for s in near:
                path.append({"at": j % fanout, "others": b"".join(s(j)).decode()})
                j //= fanout
            paths.append([*path, *({"at": a, "others": o} for a, o in tail)])
        return pa.table(
            {
                "tree": t["tree"], "pos": t["pos"], "path": pa.array(paths, pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())]))),
                "subroot": pa.array(up["subroot"].to_pylist() * t.num_rows, pa.string()), "root": pa.array(up["root"].to_pylist() * t.num_rows, pa.string()),
            }
        )

    blocks = nodes.select("tree", "pos", "n", "node", F.floor(F.col("pos") / fanout**levels).alias("block"))
    tops = above.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    return blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInArrow(run, f"tree string, pos long, path {PATH}, subroot string, root string")


def _proven(leaves: DataFrame, above: DataFrame, ident: str, fanout: int, levels: int, paths: bool) -> DataFrame:
    """Result rows of leaves (tree, pos, n, id, node, seen), from the paths of their blocks. ``seen``: the leaf to be verified instead."""

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        made = _levels(_matrix(t["node"]), t["n"][0].as_py(), fanout, levels)[:-1]
        near = [_Siblings(m, fanout) for m in made]
        tail = [(x["at"], x["others"].encode()) for x in up["path"][0].as_py()]
        sides = [(o[: 64 * a], o[64 * a :]) for a, o in tail]
        # what the proof holds above a level's nodes, from the top: a run of nodes shares it
        rest = [b"".join(o for _, o in tail)]
        for m, s in zip(made[:0:-1], near[:0:-1], strict=True):
            rest = [b"".join(s(j)) + rest[j // fanout] for j in range(len(m))]
        hexes, proofs, folded, every = [x.hex() for x in t["node"].to_pylist()], [], [], []
        root, subroot = up["root"][0].as_py(), up["subroot"][0].as_py()
        for i, (own, seen) in enumerate(zip(hexes, t["seen"].to_pylist(), strict=True)):
            proofs.append(sha256(b"".join(near[0](i)) + rest[i // fanout] if near else rest[0]).hexdigest())
            cur, j, path = (own if seen is None else seen.hex()).encode(), i, []
            for s in near:
                left, right = s(j)
                cur = sha256(left + cur + right).hexdigest().encode()
                if paths:
                    path.append({"at": j % fanout, "others": (left + right).decode()})
                j //= fanout
            for left, right in sides:
                cur = sha256(left + cur + right).hexdigest().encode()
            folded.append(cur.decode())
            if paths:
                every.append([*path, *({"at": a, "others": o.decode()} for a, o in tail)])
        out = {
            ident: t["id"], "leaf": pa.array(hexes), "subroot": pa.array([subroot] * len(hexes)), "root": pa.array([root] * len(hexes)),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded]),
        }
        if paths:
            out["path"] = pa.array(every, pa.list_(pa.struct([("at", pa.int32()), ("others", pa.string())])))
        return pa.table(out)

    blocks = leaves.withColumn("block", F.floor(F.col("pos") / fanout**levels))
    tops = above.select("tree", F.col("pos").alias("block"), "path", "subroot", "root")
    schema = f"`{ident}` {leaves.schema['id'].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInArrow(run, schema + (f", path {PATH}" if paths else ""))


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes of all rounds up to that in which each tree has one; all but the first materialised."""
    out, n = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while n > 1:
        out.append(materialise(_up(out[-1], fanout, levels), "merkle-nodes", narrow=True))
        n = -(-n // fanout**levels)
    return out


def manifest(
    df: DataFrame,
    columns: list[str],
    tree: str,
    ident: str,
    tampered: tuple[Column, dict[str, Column]] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
    paths: bool = False,
) -> DataFrame:
    """``ident``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of each row.

    ``columns`` are those of the leaf. ``tampered``: where its condition holds, the row's leaf
    is recomputed with these columns instead, and the proof of the original is folded with it; other
    rows' proofs are folded with their own leaf. ``paths``: also the proof itself, for :func:`fold`.
    """
    own = {c: F.col(f"`{c}`") for c in columns}
    where, changed = tampered or (F.lit(False), {})
    seen = F.when(where, F.unhex(leaf(own | changed)))
    made = df.select(
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{tree}`").cast("string")), F.lit("n")).alias("tree"),  # "n" sorts first
        F.col(f"`{ident}`").alias("id"), F.unhex(leaf(own)).alias("node"), seen.alias("seen"), F.monotonically_increasing_id().alias("tie"),
    )
    # written before it is dealt out: the tie of equal rows must not change if a task runs again
    leaves = materialise(made, "merkle-leaves", narrow=True)
    placed = materialise(prefix_scan(leaves, ["id", "node", "tie"], ["tree"], number="at", total="n").select(
        "tree", (F.col("at") - 1).alias("pos"), "n", "id", "node", "seen"
    ), "merkle-places", narrow=True)
    discard(leaves)
    rounds = _rounds(placed.select("tree", "pos", "n", "node"), fanout, levels)

    subroots = rounds[-1].select("tree", "node")
    ranked = prefix_scan(subroots, ["tree"], number="at", total="n").select(
        F.lit("all").alias("tree"), (F.col("at") - 1).alias("pos"), "n", "node", F.col("tree").alias("source")
    )
    ranked = materialise(ranked, "merkle-subroots", narrow=True)
    above = _rounds(ranked.select("tree", "pos", "n", "node"), fanout, levels)

    digest = F.lower(F.hex("node"))
    nothing = F.array().cast(PATH)
    way = above[-1].select("tree", "pos", nothing.alias("path"), F.lit(None).cast("string").alias("subroot"), digest.alias("root"))
    for nodes in above[-2::-1]:
        way = materialise(_down(nodes, way, fanout, levels), "merkle-paths", narrow=True)
    way = ranked.withColumn("own", digest).join(way, ["tree", "pos"]).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("own").alias("subroot"), "root")
    for nodes in rounds[-2:0:-1]:
        way = materialise(_down(nodes, way, fanout, levels), "merkle-paths", narrow=True)
    return _proven(placed, way, ident, fanout, levels, paths)
