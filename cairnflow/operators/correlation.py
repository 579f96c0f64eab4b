"""Correlating transactions with network observations, and wallets with addresses of the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(obs: DataFrame) -> DataFrame:
    """(tx, ts, src_ip, dst_ip, src_port, dst_port, country, asn, is_synthetic) of observations: trimmed addresses, upper-case countries, empty
    where unknown, and always marked as synthetic, since observations are generated."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return obs.select(
        F.col("tx").cast("bigint").alias("tx"), F.col("ts").cast("double").alias("ts"), text("src_ip").alias("src_ip"), text("dst_ip").alias("dst_ip"), F.col("src_port").try_cast("int").alias("src_port"), F.col("dst_port").try_cast("int").alias("dst_port"),
        F.upper(text("country")).alias("country"), F.coalesce(F.col("asn").try_cast("bigint"), F.lit(0)).alias("asn"), F.lit(True).alias("is_synthetic"),
    )


def tx_ips(obs: DataFrame) -> DataFrame:
    """(tx, ip, role, n, first_ts): the source of a transaction's earliest observation is its origin, other addresses relay."""
    first = obs.groupBy("tx").agg(F.min_by("src_ip", F.struct("ts", "obs")).alias("origin"))
    ends = obs.select("tx", F.col("src_ip").alias("ip"), "ts").unionByName(obs.select("tx", F.col("dst_ip").alias("ip"), "ts"))
    per = ends.groupBy("tx", "ip").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))
    return per.join(first, "tx").select("tx", "ip", F.when(F.col("ip") == F.col("origin"), "ORIGIN").otherwise("RELAY").alias("role"), "n", "first_ts")


def wallet_links(inputs: DataFrame, found: DataFrame) -> DataFrame:
    """(wallet, tx, ip, role): every address seen with a transaction that a wallet paid into, from (tx, wallet) and (tx, ip, role)."""
    return inputs.select("tx", "wallet").distinct().join(found.select("tx", "ip", "role"), "tx").select("wallet", "tx", "ip", "role")


def wallet_ips(inputs: DataFrame, found: DataFrame) -> DataFrame:
    """(wallet, ip, txs, roles, n_tx) from (tx, wallet) and (tx, ip, role); lists are sorted and distinct."""
    rows = inputs.select("tx", "wallet").distinct().join(found.select("tx", "ip", "role"), "tx")
    return rows.groupBy("wallet", "ip").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_distinct("tx").alias("n_tx"), F.min("tx").alias("first_tx"))


def ip_wallets(links: DataFrame) -> DataFrame:
    return links.groupBy("ip").agg(F.count_distinct("wallet").alias("n_wallets"), F.sum("n_tx").alias("n_links"))


def network_features(obs: DataFrame, by: str = "entity") -> DataFrame:
    """Per key: observations, distinct origins and countries, mean and largest delay from the first observation."""
    rows = obs.withColumn("delay", F.col("ts").cast("double") - F.min(F.col("ts").cast("double")).over(Window.partitionBy(by)))
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_obs"), F.avg("delay").alias("mean_delay"), F.max("delay").alias("max_delay"))
    ips = obs.select(by, "ip").distinct().groupBy(by).agg(F.count("ip").alias("n_ips"))
    countries = obs.select(by, "country").distinct().groupBy(by).agg(F.count("country").alias("n_countries"))
    return sums.join(ips, by).join(countries, by)


def propagation_gaps(obs: DataFrame, by: str = "entity") -> DataFrame:
    """(by, span_s, mean_gap_ms): span of the observations and mean gap between consecutive ones."""
    w = Window.partitionBy(by).orderBy("ts", "obs")
    t = F.col("ts").cast("double")
    gaps = obs.withColumn("gap", t - F.lag(t).over(w))
    return gaps.groupBy(by).agg((F.max(t) - F.min(t)).alias("span_s"), F.coalesce(F.avg("gap") * 1000, F.lit(0.0)).alias("mean_gap_ms"))


def fill_geo(rows: DataFrame, looked_up: DataFrame, key: str) -> DataFrame:
    """Country and asn of a lookup where the row's own are empty."""
    geo = looked_up.select(key, F.col("country").alias("geo_country"), F.col("asn").alias("geo_asn"))
    out = rows.join(geo, key, "left")
    return out.withColumn("country", F.when(F.coalesce("country", F.lit("")) == "", F.coalesce("geo_country", F.lit(""))).otherwise(F.col("country"))).withColumn("asn", F.when(F.coalesce("asn", F.lit(0)) == 0, F.coalesce("geo_asn", F.lit(0))).otherwise(F.col("asn"))).drop("geo_country", "geo_asn")


def range_join(points: DataFrame, ranges: DataFrame, point: str, bits: int = 24) -> DataFrame:
    """Points with the range [start, end] that holds them. Ranges don't overlap; each is listed under the prefixes it touches, so that
    the join is an equi join."""
    size = 1 << bits
    keyed = ranges.withColumn("__p", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))))
    at = points.withColumn("__p", F.floor(F.col(point) / size))
    return at.join(keyed, "__p", "left").where(F.col("start").isNull() | F.col(point).between(F.col("start"), F.col("end"))).drop("__p")
