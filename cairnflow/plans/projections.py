"""The driver's star-schema and event tables seen as payments, pooled payments, ownership links, telemetry and signals.

Each projection has a DataFrame form and a SQL form; the SQL forms are CTE lists for the checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.config import HeuristicConfig
from cairnflow.operators.flatten import dense_index

#: Prices as amounts: the smallest unit is a cent.
PRICES = HeuristicConfig(unit=100, dust_units=500_000, dust_min_outputs=2, dust_min_share=0.3, round_units=100, peel_gap_s=400 * 86400, peel_min_length=2, hop_dwell_s=60 * 86400, layer_min_length=2, fan=6)
#: Quantities as amounts, in whole units.
POOLS = HeuristicConfig(unit=1, pool_min_equal=2, pool_min_inputs=2, pool_min_share=0.35, dust_units=10, dust_min_outputs=2, dust_min_share=0.5, round_units=10, fan=5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Payments:
    """tx (tx_idx, txid, ts, n_in, n_out), inputs and outputs (tx_idx, addr, amount, pos). ts is in seconds."""

    tx: DataFrame
    inputs: DataFrame
    outputs: DataFrame


def seconds(c: str):
    return F.col(c).cast("timestamp").cast("long")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]
    return table(spark, sf_dir, "lineitem").select(*cols).withColumn("pos", F.row_number().over(w) - 1)


def _orders(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    n = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").join(n, "o_orderkey")
    return dense_index(orders, "tx_idx", F.col("o_orderdate"), ["o_orderdate", "o_orderkey"])


def payments(spark: SparkSession, sf_dir: str) -> Payments:
    """Orders pay their parts: the customer is the input, each line an output to part modulo customers."""
    lines = _lines(spark, sf_dir)
    orders = _orders(spark, sf_dir, lines)
    n = table(spark, sf_dir, "customer").count()
    tx = orders.select("tx_idx", F.col("o_orderkey").alias("txid"), seconds("o_orderdate").alias("ts"), F.lit(1).cast("bigint").alias("n_in"), F.col("n_lines").alias("n_out"))
    inputs = orders.select("tx_idx", F.col("o_custkey").alias("addr"), F.col("o_totalprice").alias("amount"), F.lit(0).alias("pos"))
    keyed = lines.join(tx.select("tx_idx", F.col("txid").alias("l_orderkey")), "l_orderkey")
    outputs = keyed.select("tx_idx", (F.col("l_partkey") % F.lit(n)).alias("addr"), F.col("l_extendedprice").alias("amount"), "pos")
    return Payments(tx, inputs, outputs)


def pooled(spark: SparkSession, sf_dir: str) -> Payments:
    """Suppliers are the inputs of an order and parts its outputs; quantities are the amounts."""
    lines = _lines(spark, sf_dir)
    orders = _orders(spark, sf_dir, lines)
    tx = orders.select("tx_idx", F.col("o_orderkey").alias("txid"), seconds("o_orderdate").alias("ts"), F.col("n_lines").alias("n_in"), F.col("n_lines").alias("n_out"))
    keyed = lines.join(tx.select("tx_idx", F.col("txid").alias("l_orderkey")), "l_orderkey")
    inputs = keyed.select("tx_idx", F.col("l_suppkey").alias("addr"), F.col("l_extendedprice").alias("amount"), "pos")
    outputs = keyed.select("tx_idx", F.col("l_partkey").alias("addr"), F.col("l_quantity").alias("amount"), "pos")
    return Payments(tx, inputs, outputs)


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): customers (even ids) linked to parts (odd ids) that they returned at full quantity."""
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") == 50) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs, entity, ts, country, ip, amount) from events."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("obs"), F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("country"), k.alias("ip"), F.col("value").alias("amount")
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, ml, anomaly, graph, correlation, known) in [0, 1], partly missing, from customer keys and balances."""
    k = F.col("c_custkey")
    share = lambda a, b: (k * a % b) / F.lit(float(b))
    return table(spark, sf_dir, "customer").select(
        k.alias("entity"),
        F.when(k % 7 != 0, share(37, 101)).alias("ml"),
        F.when(k % 11 != 0, share(53, 97)).alias("anomaly"),
        F.when(k % 3 != 0, share(29, 89)).alias("graph"),
        F.when(k % 5 != 0, share(17, 83)).alias("correlation"),
        F.when(k % 13 == 0, share(61, 79)).alias("known"),
        F.col("c_nationkey").alias("group"), F.col("c_acctbal").alias("volume"),
    )


#: SQL forms; each is a CTE list without WITH.
LINES = """
lines AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS pos FROM lineitem),
ord AS (SELECT o.*, n, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS tx_idx
  FROM orders o JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON o_orderkey = l_orderkey)"""
PAYMENTS = LINES + """,
tx AS (SELECT tx_idx, o_orderkey AS txid, CAST(epoch(o_orderdate) AS BIGINT) AS ts, 1 AS n_in, n AS n_out FROM ord),
inputs AS (SELECT tx_idx, o_custkey AS addr, o_totalprice AS amount, 0 AS pos FROM ord),
outputs AS (SELECT tx_idx, l_partkey % (SELECT count(*) FROM customer) AS addr, l_extendedprice AS amount, pos FROM lines JOIN ord ON l_orderkey = o_orderkey)"""
POOLED = LINES + """,
tx AS (SELECT tx_idx, o_orderkey AS txid, CAST(epoch(o_orderdate) AS BIGINT) AS ts, n AS n_in, n AS n_out FROM ord),
inputs AS (SELECT tx_idx, l_suppkey AS addr, l_extendedprice AS amount, pos FROM lines JOIN ord ON l_orderkey = o_orderkey),
outputs AS (SELECT tx_idx, l_partkey AS addr, l_quantity AS amount, pos FROM lines JOIN ord ON l_orderkey = o_orderkey)"""
OWNERSHIP = """
own AS (SELECT DISTINCT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_quantity = 50 AND l_returnflag = 'R')"""
TELEMETRY = """
obs AS (SELECT event_id AS obs, user_id AS entity, ts, event_type AS country, CAST(json_extract_string(props, '$.k') AS BIGINT) AS ip, value AS amount FROM events)"""
SIGNALS = """
sig AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 37 % 101) / 101.0 END AS ml,
  CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 53 % 97) / 97.0 END AS anomaly, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 29 % 89) / 89.0 END AS graph,
  CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 17 % 83) / 83.0 END AS correlation, CASE WHEN c_custkey % 13 = 0 THEN (c_custkey * 61 % 79) / 79.0 END AS known,
  c_nationkey AS "group", c_acctbal AS volume FROM customer)"""
