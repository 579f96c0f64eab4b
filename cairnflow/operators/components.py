"""Connected components by alternating large-star and small-star steps.

Each step replaces the edges so that every node points nearer to the smallest node of its component; about log2(n) rounds suffice.
Only edge rows move between executors; a hub costs one row for each of its edges, never a collected list, and its edges are dealt
over many tasks. Tables of the rounds before are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.durable import release, stash
from cairnflow.operators.skew import join_hot, salts


def _mins(pairs: DataFrame) -> DataFrame:
    """(u, v) rows with m, the smallest of u and its neighbours."""
    m = pairs.groupBy("u").agg(F.min("v").alias("m"), salts("v"))
    return join_hot(pairs, m.select("u", F.least("u", "m").alias("m"), "salts"), "u", "v")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node. Null ends and self loops are ignored
    (a node that has self loops only is its own component)."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    e = stash(e.distinct(), "edges")
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    e = e.where(F.col("u") != F.col("v"))
    last = before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _mins(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
        stars = _mins(down)
        e = stars.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
        e = stash(e.distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(last)
        if tuple(now) == before:
            break
        last, before = e, tuple(now)
    else:
        raise RuntimeError("components did not converge")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
