"""Evidence behind a score: ledgers, heuristic hits, seed proximity and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.operators.risk import corroborated, lone_anomaly


def _entry(category: str, cond: Column, value: Column, text: str) -> Column:
    return F.when(cond, F.struct(F.lit(category).alias("category"), F.round(value, 4).alias("value"), F.format_string(text, value).alias("headline")))


def ledger(rows: DataFrame) -> DataFrame:
    """``rows`` with ledger, an array of (category, value, headline) in a fixed order of six categories; signals that are missing or weak
    leave no entry."""
    z = lambda s: F.coalesce(s, F.lit(0.0))
    entries = F.array(
        _entry("model", z("ml") >= 0.4, F.col("ml"), "model probability %.2f"), _entry("anomaly", z("anomaly") >= 0.4, F.col("anomaly"), "unusual behaviour %.2f"),
        _entry("structure", z("graph") > 0, F.col("graph"), "transaction structure %.2f"), _entry("network", z("correlation") >= 0.4, F.col("correlation"), "network link %.2f"),
        _entry("known", z("known") > 0, F.col("known"), "near known entities %.2f"), _entry("synthesis", corroborated() | lone_anomaly(), F.col("score"), "combined score %.2f"),
    )
    return rows.withColumn("ledger", F.filter(entries, lambda x: x.isNotNull()))


def narrative(most: int = 3) -> Column:
    """The first headlines of a ledger, and how many more there are."""
    n = F.size("ledger")
    heads = F.array_join(F.transform(F.slice("ledger", 1, most), lambda x: x["headline"]), "; ")
    return F.when(n > most, F.concat(heads, F.format_string(" (+%d more)", n - most))).otherwise(heads)


def alerts(rows: DataFrame, least: float = 40.0, kind: str = "entity") -> DataFrame:
    """(alert_id, entity, score, tier, status, is_synthetic, headline) of rows at or above the least score. The id is a hash of kind
    and entity, so a rerun raises the same alerts."""
    out = ledger(rows.where(F.col("score") >= least))
    return out.select(F.substring(F.sha2(F.concat_ws(":", F.lit(kind), F.col("entity")), 256), 1, 16).alias("alert_id"), "entity", "score", "tier", F.lit("new").alias("status"), "is_synthetic", narrative().alias("headline"))


def heuristic_hits(sent: DataFrame, flags: DataFrame) -> DataFrame:
    """(entity, heuristic, n, first_tx): one row for each heuristic that an entity's sent transactions hit."""
    cols = [c for c in flags.columns if c != "tx_idx"]
    hits = F.explode(F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in cols]), lambda x: x.isNotNull())).alias("heuristic")
    return sent.join(flags, "tx_idx").select("entity", "tx_idx", hits).groupBy("entity", "heuristic").agg(F.count(F.lit(1)).alias("n"), F.min("tx_idx").alias("first_tx"))


def seed_evidence(rows: DataFrame) -> DataFrame:
    """(entity, hops, nearest, boost): nulls for entities out of reach, no nearest seed for seeds."""
    out = F.col("hops") < 0
    return rows.select("entity", F.when(~out, F.col("hops")).alias("hops"), F.when(~out & (F.col("hops") > 0), F.col("nearest")).alias("nearest"), F.round(F.col("score") - F.col("score_base"), 2).alias("boost"))


def address_heads(members: DataFrame, most: int = 10) -> DataFrame:
    """(entity, n_addresses, addresses): the smallest addresses of each entity, comma-joined."""
    from pyspark.sql import Window

    n = members.groupBy("entity").agg(F.count(F.lit(1)).alias("n_addresses"))
    top = members.withColumn("rn", F.row_number().over(Window.partitionBy("entity").orderBy("addr"))).where(F.col("rn") <= most)
    heads = top.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list("addr")), lambda x: x.cast("string")), ",").alias("addresses"))
    return n.join(heads, "entity")
