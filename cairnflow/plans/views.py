"""Wallets, transactions and paths as tables for a screen: every row has one shape, and one row or many come from the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.operators import graph, risk

#: Shapes of the rows.
TRANSACTION = "tx bigint, score double, tier string, inputs array<string>, outputs array<string>, n_correlations bigint, is_synthetic boolean"
WALLET = "wallet string, n_txs bigint, score double, tier string, method string, n_counterparties bigint, is_synthetic boolean"
PATH = "step int, src string, dst string, relationship string, is_synthetic boolean, confidence double"


def transactions(tx: DataFrame, edges: DataFrame, scores: DataFrame, correlations: DataFrame) -> DataFrame:
    """TRANSACTION rows of (tx): sorted distinct wallets on either side (from typed edges), its score if it has one, and whether any of
    its score or correlations (tx, is_synthetic) is synthetic."""
    into = edges.where("relationship = 'addr_tx'").groupBy(F.col("dst").alias("__tx")).agg(F.array_sort(F.collect_set("src")).alias("inputs"))
    out = edges.where("relationship = 'tx_addr'").groupBy(F.col("src").alias("__tx")).agg(F.array_sort(F.collect_set("dst")).alias("outputs"))
    found = correlations.groupBy("tx").agg(F.count(F.lit(1)).alias("n_correlations"), F.bool_or("is_synthetic").alias("synthetic_links"))
    rows = tx.select("tx", F.col("tx").cast("string").alias("__tx")).join(into, "__tx", "left").join(out, "__tx", "left").join(scores, "tx", "left").join(found, "tx", "left")
    empty, no = F.array().cast("array<string>"), F.lit(False)
    synthetic = F.coalesce("is_synthetic", no) | F.coalesce("synthetic_links", no)
    return rows.select("tx", "score", "tier", F.coalesce("inputs", empty).alias("inputs"), F.coalesce("outputs", empty).alias("outputs"), F.coalesce("n_correlations", F.lit(0)).cast("bigint").alias("n_correlations"), synthetic.alias("is_synthetic"))


METHODS = {"max": "max_score", "mean": "mean_score", "volume_weighted": "weighted_score", "frequency": "frequency_score"}


def wallets(edges: DataFrame, tx: DataFrame, scores: DataFrame, method: str = "max") -> DataFrame:
    """WALLET rows of all wallets that typed edges join to a transaction of (tx, illicit, volume): the aggregate of its transactions'
    scores, 80 or 10 for those without one, and how many wallets it dealt with."""
    links = edges.where("relationship = 'addr_tx'").select(F.col("src").alias("wallet"), F.col("dst").alias("t")).union(edges.where("relationship = 'tx_addr'").select("dst", "src")).distinct()
    scored = risk.default_scores(tx.select("tx", "illicit"), scores).join(tx.select("tx", "volume"), "tx").withColumn("t", F.col("tx").cast("string"))
    per = risk.rollup(links.join(scored, "t"), "wallet", "tx")
    n = links.groupBy("wallet").agg(F.count(F.lit(1)).alias("n_txs"))
    pairs = edges.where("relationship = 'addr_addr'").select(F.col("src").alias("wallet"), F.col("dst").alias("other"))
    others = pairs.union(pairs.select("other", "wallet")).distinct().groupBy("wallet").agg(F.count(F.lit(1)).alias("n_counterparties"))
    rows = n.join(per, "wallet", "left").join(others, "wallet", "left")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(METHODS[method]))), 2)
    return rows.select("wallet", "n_txs", score.alias("score"), risk.tier(score).alias("tier"), F.lit(method).alias("method"), F.coalesce("n_counterparties", F.lit(0)).cast("bigint").alias("n_counterparties"), F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"))


def path(edges: DataFrame, source, target) -> DataFrame:
    """PATH rows of a shortest directed path; no rows without one."""
    return graph.path_edges(edges, graph.shortest_path(edges, source, target))
