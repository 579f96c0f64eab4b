"""Streaming queries over the events table, drained to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnflow.durable import run_dir, stash
from cairnflow.plans import projections as P
from cairnflow.plans.registry import query
from cairnflow.streaming import replay


def _stream(spark, d):
    schema = P.table(spark, d, "events").schema
    return replay.source(spark, f"{d}/*events.parquet", schema)


def _drained(spark, stream, mode: str = "append"):
    tag = uuid.uuid4().hex
    return replay.drain(stream, f"{run_dir(spark)}/drained-{tag}", f"{run_dir(spark)}/stream-{tag}", mode)


@query("t01_stream_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def t01(spark, d):
    out = _drained(spark, replay.hourly(_stream(spark, d)), "complete")
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("t02_stream_first_seen", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def t02(spark, d):
    return _drained(spark, replay.first_seen(_stream(spark, d), "user_id", "60 days")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("t03_stream_bursts", """WITH g AS (SELECT user_id, ts, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 600, true) AS new FROM events),
 s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def t03(spark, d):
    out = _drained(spark, replay.bursts(_stream(spark, d)), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("t04_feed_edges", "SELECT event_id AS src, event_id + 1 AS dst FROM events WHERE event_id % 3 = 0 AND event_id + 1 IN (SELECT event_id FROM events)")
def t04(spark, d):
    e = P.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("src"), (F.col("event_id") + 1).alias("dst"))
    at = f"{run_dir(spark)}/feed-{uuid.uuid4().hex}"
    feed = replay.Feed(spark, at, e)
    feed.run(_stream(spark, d), f"{at}/checkpoint")
    return feed.active_edges()


SIM = """,
e AS (SELECT DISTINCT 'w' || i.addr AS src, CAST(txid AS VARCHAR) AS dst, 'addr_tx' AS relationship FROM inputs i JOIN tx ON tx.tx_idx = i.tx_idx UNION ALL SELECT DISTINCT CAST(txid AS VARCHAR), 'w' || o.addr, 'tx_addr' FROM outputs o JOIN tx ON tx.tx_idx = o.tx_idx
 UNION ALL SELECT CAST(txid AS VARCHAR), CAST(lead(txid) OVER (ORDER BY tx_idx) AS VARCHAR), 'tx_tx' FROM tx UNION ALL SELECT DISTINCT 'w' || i.addr, 'w' || o.addr, 'addr_addr' FROM inputs i JOIN outputs o ON o.tx_idx = i.tx_idx),
cur AS (SELECT {step} AS entered), ins AS (SELECT CAST(txid AS VARCHAR) AS id, tx_idx FROM tx WHERE tx_idx < (SELECT entered FROM cur)),
wal AS (SELECT src AS id FROM e WHERE relationship = 'addr_tx' AND dst IN (SELECT id FROM ins) UNION SELECT dst FROM e WHERE relationship = 'tx_addr' AND src IN (SELECT id FROM ins)),
act AS (SELECT * FROM e WHERE CASE relationship WHEN 'addr_tx' THEN dst IN (SELECT id FROM ins) WHEN 'tx_addr' THEN src IN (SELECT id FROM ins) WHEN 'tx_tx' THEN src IN (SELECT id FROM ins) AND dst IN (SELECT id FROM ins)
 ELSE src IN (SELECT id FROM wal) AND dst IN (SELECT id FROM wal) END),
status AS (SELECT CAST(entered AS BIGINT) AS current_step, (SELECT count(*) FROM tx) AS total_steps, entered < (SELECT count(*) FROM tx) AS can_inject_next, (SELECT txid FROM tx WHERE tx_idx = entered - 1) AS last_txid, (SELECT txid FROM tx WHERE tx_idx = entered) AS next_txid,
 (SELECT count(*) FROM ins) AS total_transactions, (SELECT count(*) FROM wal) AS total_wallets, (SELECT count(*) FROM act) AS total_edges FROM cur)"""
HALF = "(SELECT count(*) // 2 + 1 FROM tx)"


def _simulation(spark, d):
    """All payments as transactions, with the four kinds of edges."""
    b = P.payments(spark, d)
    tx = stash(b.tx.select("tx_idx", "txid"), "tx")
    inputs, outputs = stash(b.inputs.select("tx_idx", "addr"), "inputs"), stash(b.outputs.select("tx_idx", "addr"), "outputs")
    wallet, name = F.concat(F.lit("w"), F.col("addr").cast("string")), F.col("txid").cast("string")
    i, o = inputs.join(tx, "tx_idx").select("tx_idx", wallet.alias("a"), name.alias("t")), outputs.join(tx, "tx_idx").select("tx_idx", wallet.alias("b"), name.alias("t"))
    nxt = tx.select((F.col("tx_idx") - 1).alias("tx_idx"), name.alias("dst"))
    edges = i.select(F.col("a").alias("src"), F.col("t").alias("dst"), F.lit("addr_tx").alias("relationship")).unionByName(o.select(F.col("t").alias("src"), F.col("b").alias("dst"), F.lit("tx_addr").alias("relationship")))
    edges = edges.unionByName(tx.join(nxt, "tx_idx").select(name.alias("src"), "dst", F.lit("tx_tx").alias("relationship"))).unionByName(i.join(o.drop("t"), "tx_idx").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("addr_addr").alias("relationship")))
    return replay.Simulation(spark, f"{run_dir(spark)}/simulation-{uuid.uuid4().hex}", tx, stash(edges, "edges"))


@query("t01_inject", "WITH " + P.PAYMENTS + f" SELECT tx_idx, txid FROM tx WHERE tx_idx >= 1 AND tx_idx < {HALF}")
def t01_inject(spark, d):
    sim = _simulation(spark, d)
    sim.inject_next()
    return sim.inject_batch(sim.total // 2)


@query("t02_activation", "WITH " + P.PAYMENTS + SIM.format(step=HALF) + " SELECT src, dst, relationship FROM act")
def t02_activation(spark, d):
    sim = _simulation(spark, d)
    sim.inject()
    sim.inject(sim.total // 2)
    return sim.active_edges()


@query("t03_reset", "WITH " + P.PAYMENTS + SIM.format(step="1") + " SELECT * FROM status")
def t03_reset(spark, d):
    sim = _simulation(spark, d)
    sim.reset("full")
    return sim.reset("baseline")


@query("t04_status", "WITH " + P.PAYMENTS + SIM.format(step="(SELECT count(*) FROM tx)") + " SELECT * FROM status")
def t04_status(spark, d):
    sim = _simulation(spark, d)
    sim.inject_batch(sim.total // 3 + 1)
    return sim.reset("full")
