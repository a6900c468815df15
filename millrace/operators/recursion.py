"""Recursion as rounds of joins: which nodes can be reached from roots, and in how many steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import written


def reachable(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops): nodes reached from ``roots`` (node) along ``edges`` (src, dst), with the fewest steps, in at most ``most`` steps.

    Each round joins only the nodes found last with the edges and leaves out what is known, so cycles end by themselves; it is
    written, so plans don't grow with the depth, and a lost executor repeats no earlier round. Nulls are no nodes.
    """
    links = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    found = [written(roots.where("node IS NOT NULL").select("node").distinct().withColumn("hops", F.lit(0)), "reached")]
    while most is None or len(found) <= most:
        known = found[0]
        for x in found[1:]:
            known = known.unionByName(x)
        step = links.join(found[-1].select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        fresh = written(step.join(known.select("node"), "node", "left_anti").withColumn("hops", F.lit(len(found))), "reached")
        if not fresh.take(1):
            break
        found.append(fresh)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
