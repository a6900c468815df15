"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, keep: str) -> DataFrame:
    """For each u, its neighbours ``keep`` linked to the least of u and all that are given. Edges: u, v."""
    # aggregated map-side and joined back, so that a hub's neighbours never meet in one window
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = edges.join(least, "u")
    out = linked.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep == "true":  # small star: u itself is linked, too
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to ``node``, ``label``: the least node of its component, for each linked node.

    Rounds grow with the logarithm of a component's size. Each round's edges are written to the
    shared folder, and so is the result; only a count and a checksum come to the driver.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
        narrow=True,
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "v > u")
        # each edge from its greater end
        small = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "true")
        new = materialise(small, "edges", narrow=True)
        discard(edges)
        edges = new
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
    out = materialise(found, "labels", narrow=True)
    discard(edges)
    return out
