"""Entities as clusters of addresses, and their features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.config import EntityConfig
from cairnflow.functions.scalars import wilson
from cairnflow.operators.components import connected_components

C = EntityConfig()


def first_inputs(inputs: DataFrame) -> DataFrame:
    """(tx_idx, sender): the address at the first position."""
    return inputs.groupBy("tx_idx").agg(F.min_by("addr", "pos").alias("sender"))


def ownership_edges(tx: DataFrame, inputs: DataFrame, pool: DataFrame, changes: DataFrame, c: EntityConfig = C) -> DataFrame:
    """(src, dst): inputs spent together, and sure change, linked to the first input; pooled transactions link nothing."""
    plain = pool.where(~F.col("is_pool")).select("tx_idx")
    first = first_inputs(inputs)
    joint = inputs.join(tx.where("n_in >= 2").join(plain, "tx_idx", "left_semi").select("tx_idx"), "tx_idx", "left_semi").join(first, "tx_idx").select(F.col("addr").alias("src"), F.col("sender").alias("dst"))
    sure = changes.where(F.col("change_addr").isNotNull() & (F.col("confidence") >= c.link_min_confidence)).join(plain, "tx_idx", "left_semi")
    return joint.unionByName(sure.join(first, "tx_idx").select(F.col("change_addr").alias("src"), F.col("sender").alias("dst"))).distinct()


def resolve(addresses: DataFrame, edges: DataFrame) -> DataFrame:
    """(addr, entity) of every address; the entity is the smallest address of its cluster."""
    found = connected_components(edges)
    return addresses.select("addr").distinct().join(found.withColumnRenamed("node", "addr"), "addr", "left").select("addr", F.coalesce("component", "addr").alias("entity"))


def clustering_quality(members: DataFrame, truth: DataFrame) -> DataFrame:
    """(purity, clusters_per_entity, merged_share) of (addr, entity) against (addr, owner)."""
    cell = members.join(truth, "addr").groupBy("entity", "owner").agg(F.count(F.lit(1)).alias("n"))
    purity = cell.groupBy("entity").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))
    owners = cell.groupBy("owner").agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n")).where("n >= 2")
    return purity.join(F.broadcast(owners.agg(F.avg("clusters").alias("clusters_per_entity"), F.avg((F.col("clusters") == 1).cast("double")).alias("merged_share"))))


def sent(inputs: DataFrame, member: DataFrame) -> DataFrame:
    """(entity, tx_idx, amount)."""
    return inputs.join(member, "addr").groupBy("entity", "tx_idx").agg(F.sum("amount").alias("amount"))


def external_outputs(outputs: DataFrame, member: DataFrame, sent_rows: DataFrame) -> DataFrame:
    """Outputs whose entity isn't an input entity of the same transaction."""
    return outputs.join(member, "addr").join(sent_rows.select("entity", "tx_idx"), ["entity", "tx_idx"], "left_anti")


def received(external: DataFrame) -> DataFrame:
    return external.groupBy("entity", "tx_idx").agg(F.sum("amount").alias("amount"))


def flows(tx: DataFrame, inputs: DataFrame, outputs: DataFrame, member: DataFrame, pool: DataFrame, external: DataFrame) -> DataFrame:
    """(src, dst, amount, ts, tx_idx). A plain transaction's outputs flow from its first input's entity; a pooled one's from every
    input entity, the amount shared among the sources that differ from the receiver."""
    plain = pool.where(~F.col("is_pool")).select("tx_idx")
    sender = first_inputs(inputs).join(member.withColumnRenamed("addr", "sender"), "sender").select("tx_idx", F.col("entity").alias("src"))
    own = external.join(plain, "tx_idx", "left_semi").join(sender, "tx_idx").where("src <> entity").select("src", F.col("entity").alias("dst"), "amount", "tx_idx")
    pooled = pool.where("is_pool").select("tx_idx")
    into = inputs.join(pooled, "tx_idx", "left_semi").join(member, "addr").select("tx_idx", F.col("entity").alias("src")).distinct()
    out = outputs.join(pooled, "tx_idx", "left_semi").join(member, "addr").select("tx_idx", F.col("entity").alias("dst"), "amount")
    pairs = into.join(out, "tx_idx").where("src <> dst")
    shares = pairs.select("tx_idx", "src").distinct().groupBy("tx_idx").agg(F.count(F.lit(1)).alias("k"))
    split = pairs.join(shares, "tx_idx").select("src", "dst", (F.col("amount") / F.col("k")).alias("amount"), "tx_idx")
    return own.unionByName(split).join(tx.select("tx_idx", "ts"), "tx_idx").select("src", "dst", "amount", "ts", "tx_idx")


def sent_stats(sent_rows: DataFrame, tx: DataFrame) -> DataFrame:
    return sent_rows.join(tx.select("tx_idx", "n_in", "n_out"), "tx_idx").groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_sent"), F.sum("amount").alias("total_sent"), F.avg("amount").alias("mean_sent"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_sent"),
        F.avg("n_out").alias("mean_n_out"), F.max("n_out").alias("max_n_out"), F.avg("n_in").alias("mean_n_in"), F.max("n_in").alias("max_n_in"),
    )


def recv_stats(recv_rows: DataFrame) -> DataFrame:
    return recv_rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_recv"), F.sum("amount").alias("total_recv"), F.avg("amount").alias("mean_recv"))


def pass_through(spine: DataFrame, s: DataFrame, r: DataFrame) -> DataFrame:
    rows = spine.join(s, "entity", "left").join(r, "entity", "left").fillna(0)
    most = F.greatest("total_sent", "total_recv")
    return rows.select(
        "entity", (F.col("n_sent") + F.col("n_recv")).alias("n_events"), F.when(most > 0, F.least("total_sent", "total_recv") / most).otherwise(0.0).alias("pass_through_ratio"),
        (F.col("n_recv") / (F.col("n_sent") + 1)).alias("recv_to_sent"),
    )


def degrees(flow: DataFrame) -> DataFrame:
    """Distinct counterparties either way, and what flows out."""
    pairs = flow.groupBy("src", "dst").agg(F.sum("amount").alias("amount"), F.max("amount").alias("top"))
    out = pairs.groupBy(F.col("src").alias("entity")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("amount").alias("flow_out"), F.max("top").alias("max_out"))
    into = pairs.groupBy(F.col("dst").alias("entity")).agg(F.count(F.lit(1)).alias("in_degree"))
    return out.join(into, "entity", "full_outer").fillna(0)


def events_of(sent_rows: DataFrame, recv_rows: DataFrame, tx: DataFrame) -> DataFrame:
    """(entity, tx_idx, ts), each once."""
    both = sent_rows.select("entity", "tx_idx").unionByName(recv_rows.select("entity", "tx_idx")).distinct()
    return both.join(tx.select("tx_idx", "ts"), "tx_idx")


def activity(events: DataFrame, c: EntityConfig = C) -> DataFrame:
    """(entity, active_hours, burstiness, median_gap_s): burstiness is 0 below the least number of gaps."""
    w = Window.partitionBy("entity").orderBy("ts", "tx_idx")
    gaps = events.withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    a = gaps.groupBy("entity").agg(((F.max("ts") - F.min("ts")) / 3600).alias("active_hours"), F.count("gap").alias("n"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("s"), F.percentile("gap", F.lit(0.5)).alias("median_gap_s"))
    burst = F.when(F.col("n") >= c.burst_min_gaps, (F.col("s") - F.col("m")) / (F.col("s") + F.col("m") + 1e-9)).otherwise(0.0)
    return a.select("entity", "active_hours", burst.alias("burstiness"), F.coalesce("median_gap_s", F.lit(0.0)).alias("median_gap_s"))


def peak_hour(events: DataFrame) -> DataFrame:
    hours = events.groupBy("entity", F.floor(F.col("ts") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy("entity").agg(F.max("n").alias("peak_events"), (F.max("n") / F.sum("n")).alias("peak_share"))


def dwell(inputs: DataFrame, tx: DataFrame, life: DataFrame, member: DataFrame, c: EntityConfig = C) -> DataFrame:
    """(entity, median_dwell_s, rapid_spend_share) over all inputs; a never-received input has no dwell and isn't rapid."""
    rows = inputs.join(life.select("addr", "first_recv_ts", "first_recv_tx"), "addr").join(tx.select("tx_idx", "ts"), "tx_idx").join(member, "addr")
    d = F.when((F.col("first_recv_ts") >= 0) & (F.col("first_recv_tx") < F.col("tx_idx")), F.col("ts") - F.col("first_recv_ts"))
    return rows.withColumn("d", d).groupBy("entity").agg(F.coalesce(F.percentile("d", F.lit(0.5)), F.lit(-1.0)).alias("median_dwell_s"), F.avg(F.coalesce(F.col("d") < c.rapid_spend_s, F.lit(False)).cast("double")).alias("rapid_spend_share"))


def receipt_uniformity(recv_rows: DataFrame, c: EntityConfig = C) -> DataFrame:
    a = recv_rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("amount").alias("s"), F.avg("amount").alias("m"))
    return a.select("entity", F.when(F.col("n") >= c.uniform_min_receipts, F.col("s") / (F.col("m") + 1e-12)).otherwise(-1.0).alias("recv_amount_cv"))


def participation(sent_rows: DataFrame, flags: DataFrame) -> DataFrame:
    """Sums of the numeric flag columns of (tx_idx, ...) over an entity's sent transactions."""
    cols = [c for c in flags.columns if c != "tx_idx"]
    return sent_rows.join(flags, "tx_idx").groupBy("entity").agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in cols])


def network_shares(rows: DataFrame) -> DataFrame:
    """(entity, n, n_origin_ips, n_origin_countries) of (entity, ip, country); an empty country is a value."""
    ips = rows.groupBy("entity", "ip").agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.sum("n").alias("n"), F.count("ip").alias("n_origin_ips"))
    countries = rows.select("entity", "country").distinct().groupBy("entity").agg(F.count("country").alias("n_origin_countries"))
    return ips.join(countries, "entity")


def origin_link(rows: DataFrame) -> DataFrame:
    """(entity, top_ip, top_ip_share, low, high): the commonest origin (ties to the smallest) and the Wilson interval of its share."""
    n = rows.groupBy("entity", "ip").agg(F.count(F.lit(1)).alias("k"))
    top = n.groupBy("entity").agg(F.min_by("ip", F.struct(-F.col("k"), "ip")).alias("top_ip"), F.max("k").alias("k"), F.sum("k").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return top.select("entity", "top_ip", (F.col("k") / F.col("n")).alias("top_ip_share"), low.alias("low"), high.alias("high"))


def rapid_changes(rows: DataFrame, what: str, within_s: int, order: list[str]) -> DataFrame:
    """(entity, rapid): consecutive rows whose ``what`` differs, less than ``within_s`` apart."""
    w = Window.partitionBy("entity").orderBy(*order)
    hop = (F.col(what) != F.lag(what).over(w)) & (F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w) < within_s)
    return rows.withColumn("hop", hop).groupBy("entity").agg(F.count_if("hop").alias("rapid"))


def runs(rows: DataFrame, what: str, order: list[str]) -> DataFrame:
    """(entity, run, what, first_ts, last_ts, n): stretches of consecutive rows of an entity that agree in ``what``, numbered from 1."""
    w = Window.partitionBy("entity").orderBy(*order)
    new = F.coalesce(~F.col(what).eqNullSafe(F.lag(what).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    numbered = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("entity", "run").agg(F.first(what).alias(what), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def obfuscation(tor: F.Column, vpn: F.Column, hops: F.Column) -> F.Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * tor + 0.4 * vpn + 0.15 * F.least(hops, F.lit(3)) / 3))


def labels_from_truth(members: DataFrame, truth: DataFrame) -> DataFrame:
    """(entity, illicit_share, is_illicit, scenario) from (addr, illicit, scenario): the commonest scenario among illicit addresses
    (ties to the smaller name), normal without."""
    rows = members.join(truth, "addr")
    share = rows.groupBy("entity").agg(F.avg(F.col("illicit").cast("double")).alias("illicit_share"))
    n = rows.where("illicit").groupBy("entity", "scenario").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("entity").agg(F.min_by("scenario", F.struct(-F.col("n"), "scenario")).alias("top"))
    ill = F.col("illicit_share") >= 0.5
    return share.join(top, "entity", "left").select("entity", "illicit_share", ill.alias("is_illicit"), F.when(ill, F.col("top")).otherwise("normal").alias("scenario"))


def feature_matrix(spine: DataFrame, *features: DataFrame) -> DataFrame:
    """All feature frames on the entity spine, missing values as 0."""
    out = spine
    for f in features:
        out = out.join(f, "entity", "left")
    return out.fillna(0)
