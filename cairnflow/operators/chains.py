"""Following forward links to chains.

Every node has one successor at most, later than itself, so the links form an in-forest. Lengths come from pointer doubling: each round
joins a node's pointer with that pointer's pointer, so a chain of n needs about log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.durable import stash


def path_lengths(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, length): nodes on the way from ``node`` to the end of its chain, both counted."""
    nodes = links.select(F.col("tx_idx").alias("node")).unionByName(links.select(F.col("next").alias("node"))).distinct()
    at = nodes.join(links.select(F.col("tx_idx").alias("node"), F.col("next").alias("to")), "node", "left")
    at = stash(at.withColumn("steps", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long")), "chain")
    for _ in range(max_rounds):
        if not at.where(F.col("to").isNotNull()).limit(1).count():
            break
        far = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("more"))
        at = stash(at.join(far, "to", "left").select("node", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chain")
    return at.select("node", (F.col("steps") + 1).alias("length"))


def follow(links: DataFrame, min_length: int, max_rounds: int = 40) -> DataFrame:
    """(tx_idx, start, pos, length) of the nodes on qualifying chains.

    A chain starts at a node without predecessor and qualifies with ``min_length`` nodes. Where chains meet, the shared rest belongs
    to the latest qualifying start; positions and lengths are of that start's chain."""
    links = stash(links, "links")
    lengths = stash(path_lengths(links, max_rounds), "lengths")
    starts = links.select(F.col("tx_idx").alias("node")).join(links.select(F.col("next").alias("node")), "node", "left_anti").distinct()
    starts = starts.join(lengths, "node").where(F.col("length") >= min_length).select("node", "length")
    back = stash(links.select(F.col("tx_idx").alias("prev"), F.col("next").alias("node")), "back")
    # best start known to reach a node; doubled by composing jump tables
    best = stash(lengths.select("node").join(starts.select("node", F.col("node").alias("start")), "node", "left"), "best")
    jump = back.select(F.col("prev").alias("a"), F.col("node").alias("b"))
    for _ in range(max_rounds):
        if not jump.limit(1).count():
            break
        arrived = jump.join(best.where("start is not null").select(F.col("node").alias("a"), "start"), "a").groupBy(F.col("b").alias("node")).agg(F.max("start").alias("via"))
        best = stash(best.join(arrived, "node", "left").select("node", F.greatest("start", "via").alias("start")), "best")
        jump = stash(jump.select("a", F.col("b").alias("m")).join(jump.select(F.col("a").alias("m"), "b"), "m").select("a", "b"), "jump")
    owned = best.where("start is not null").join(lengths, "node")
    return owned.join(starts.select(F.col("node").alias("start"), F.col("length").alias("total")), "start").select(
        F.col("node").alias("tx_idx"), "start", (F.col("total") - F.col("length")).alias("pos"), F.col("total").alias("length")
    )
