"""Connected components of a table of links, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def components(links: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable) of every node in links (a, b).

    Each round every node moves to the smallest node next to it, then twice along those moves; links are rewritten.
    The number of nodes in a component falls at least by half with hardly any exceptions, so rounds are few.
    Empty links give an empty table. Repeated links and links of a node to itself do no harm.
    """
    edges = materialize(links.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    out = materialize(ends.distinct().withColumn("comp", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("p")))
        far = step
        for _ in range(2):
            q = step.select(F.col("u").alias("u2"), F.col("p").alias("p2"))
            far = far.join(q, far["p"] == q["u2"], "left").select("u", F.coalesce("p2", "p").alias("p"))
        jump = materialize(far)
        ja, jb = jump.select(F.col("u").alias("ua"), F.col("p").alias("pa")), jump.select(F.col("u").alias("ub"), F.col("p").alias("pb"))
        moved = edges.join(ja, F.col("a") == F.col("ua")).join(jb, F.col("b") == F.col("ub"))
        new_edges = materialize(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        new_out = materialize(out.join(jump, F.col("comp") == F.col("u"), "left").select("node", F.coalesce("p", "comp").alias("comp")))
        forget(edges, step, jump, out)
        edges, out = new_edges, new_out
    forget(edges)
    return out


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp: of nodes that are not named after themselves) after links (a, b) more; only links between
    components are followed, each once."""
    ca, cb = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    lifted = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    edges = materialize(lifted.where("a <> b").distinct())
    new = components(edges)
    old = comps.join(new.select(F.col("node").alias("u"), F.col("comp").alias("v")), F.col("comp") == F.col("u"), "left").select("node", F.coalesce("v", "comp").alias("comp"))
    out = materialize(old.unionByName(new.where("node <> comp")))
    forget(comps, edges, new)
    return out
