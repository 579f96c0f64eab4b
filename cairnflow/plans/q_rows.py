"""Queries of operators that other queries hold inside."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnflow.durable import run_dir, stash
from cairnflow.functions import scalars as S
from cairnflow.operators import correlation, entities, flatten, graph, heuristics, ordered, risk
from cairnflow.plans import projections as P
from cairnflow.plans.q_flow import CHANGE, FANS, LIFE, PEEL, WP, Book, W, r
from cairnflow.plans.q_graph import ADJ, EGO, TRADE, trade
from cairnflow.plans.q_risk import ALERTS, SCORED, alerts, scored
from cairnflow.plans.registry import query
from cairnflow.sources import raw


def _rollup(spark, d, column):
    return r(risk.rollup(scored(spark, d), "group"), 6, column).select("group", column)


@query("a02_mean", "WITH " + SCORED + ' SELECT "group", round(avg(score), 6) AS mean_score FROM scored GROUP BY 1')
def a02(spark, d):
    return _rollup(spark, d, "mean_score")


@query("a03_volume_weighted", "WITH " + SCORED + ' SELECT "group", round(sum(score * volume) / sum(volume), 6) AS weighted_score FROM scored GROUP BY 1')
def a03(spark, d):
    return _rollup(spark, d, "weighted_score")


@query("a04_frequency", "WITH " + SCORED + ' SELECT "group", round(100 * avg(CASE WHEN score >= 40 THEN 1.0 ELSE 0 END), 6) AS frequency_score FROM scored GROUP BY 1')
def a04(spark, d):
    return _rollup(spark, d, "frequency_score")


@query("f02_int_to_ip", "SELECT event_id, (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) AS ip FROM (SELECT event_id, event_id * 7919 % 4294967296 AS n FROM events)")
def f02(spark, d):
    return P.table(spark, d, "events").select("event_id", S.int_to_ip(F.col("event_id") * 7919 % 4294967296).alias("ip"))


@query("f05_in_window", "WITH " + P.PAYMENTS + " SELECT tx_idx, ts >= 800000000 - 86400 AND ts < 850000000 + 86400 AS inside FROM tx")
def f05(spark, d):
    return P.payments(spark, d).tx.select("tx_idx", S.in_window(F.col("ts"), F.lit(800_000_000), F.lit(850_000_000), 86400).alias("inside"))


@query("f12_seed_boost", "WITH " + SCORED + " SELECT entity, round(greatest(0, least(100, score + (100 - score) * 0.5 * ((entity % 11) / 11.0))), 6) AS boosted FROM scored")
def f12(spark, d):
    return scored(spark, d).select("entity", F.round(S.seed_boost(F.col("score"), F.col("entity") % 11 / 11.0), 6).alias("boosted"))


@query("f23_text_search", "WITH " + ALERTS + " SELECT entity FROM alerts WHERE entity IN (SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%omer#00000001%') OR entity IN (SELECT o_custkey FROM orders WHERE 'omer#00000001' || o_orderkey LIKE 'omer#000000011%')")
def f23(spark, d):
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("addr"))
    o = P.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.when(F.col("o_orderkey").cast("string").startswith("1"), F.concat(F.lit("OMER#00000001"), F.col("o_orderkey"))).alias("txid"))
    return risk.search(alerts(spark, d), " Omer#00000001", o, c).select("entity")


@query("h07_valid_peels", W + LIFE + CHANGE + PEEL + " SELECT tx_idx FROM valid")
def h07(spark, d):
    b = Book(spark, d).written()
    life = stash(b.life, "life")
    found = stash(heuristics.change(b.tx, b.outputs, life, b.pool, b.c), "changes").where("change_addr is not null").select("tx_idx", F.col("change_addr").alias("addr"))
    return heuristics.valid_peels(b.tx, b.pool, found, heuristics.successors(found, b.tx, life, b.c.peel_gap_s), b.c)


@query("h13_batch_payout", WP + FANS + " SELECT tx_idx FROM fan WHERE batch_payout")
def h13(spark, d):
    b = Book(spark, d, pooled=True)
    return heuristics.fans(b.tx, b.pool, heuristics.dust(b.tx, b.outputs, b.c), b.c).where("batch_payout").select("tx_idx")


@query("p10_fee", WP + """, i AS (SELECT tx_idx, sum(amount) AS a FROM inputs GROUP BY 1), o AS (SELECT tx_idx, sum(amount) AS b FROM outputs GROUP BY 1)
 SELECT tx_idx, round(CASE WHEN tx_idx % 5 = 0 THEN 1.25 WHEN tx_idx % 7 = 0 THEN 0 ELSE greatest(a - b * 100, 0) END, 2) AS fee FROM i JOIN o USING (tx_idx)""")
def p10(spark, d):
    b = Book(spark, d, pooled=True)
    sums = b.inputs.groupBy("tx_idx").agg(F.sum("amount").alias("a")).join(b.outputs.groupBy("tx_idx").agg(F.sum("amount").alias("b")), "tx_idx")
    k = F.col("tx_idx")
    fee = flatten.derive_fee(F.when(k % 5 == 0, 1.25), F.when(k % 7 == 0, 0).otherwise(1), F.col("a"), F.col("b") * 100)
    return sums.select("tx_idx", F.round(fee, 2).alias("fee"))


@query("w02_country_changes", "WITH " + P.TELEMETRY + ", h AS (SELECT entity, country <> lag(country) OVER (PARTITION BY entity ORDER BY ts) AS hop FROM obs) SELECT entity, count(*) FILTER (WHERE hop) AS rapid FROM h GROUP BY 1")
def w02(spark, d):
    return entities.rapid_changes(P.telemetry(spark, d), "country", 10**10, ["ts", "obs"])


@query("w03_capped_per_source", "WITH " + TRADE + ADJ.format(flow="trade", a=2, b=3) + " SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(w, 6) AS w FROM adj")
def w03(spark, d):
    from cairnflow.config import GraphConfig

    return r(graph.adjacency(trade(spark, d), GraphConfig(per_source=2, per_node=3)), 6, "w")


@query("w04_first_of_group", WP + " SELECT tx_idx, pos, first_value(addr) OVER (PARTITION BY tx_idx ORDER BY pos) AS sender FROM inputs")
def w04(spark, d):
    inputs = stash(Book(spark, d, pooled=True).inputs, "inputs")
    return inputs.select("tx_idx", F.col("pos").cast("bigint").alias("pos")).join(entities.first_inputs(inputs), "tx_idx")


@query("w07_runs", "WITH " + P.TELEMETRY + """, g AS (SELECT *, CASE WHEN country IS DISTINCT FROM lag(country) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM obs WINDOW w AS (PARTITION BY entity ORDER BY ts)), n AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY ts) AS run FROM g)
 SELECT entity, CAST(run AS BIGINT) AS run, min(country) AS country, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM n GROUP BY 1, 2""")
def w07(spark, d):
    out = entities.runs(P.telemetry(spark, d), "country", ["ts", "obs"])
    return out.select("entity", "run", "country", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "n")


@query("w08_rank_over_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def w08(spark, d):
    rows = P.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ordered.running(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], {"rank": F.lit(1)}).select("o_orderkey", "rank")


@query("w09_propagation_gaps", "WITH " + P.TELEMETRY + ", g AS (SELECT entity, epoch(ts) AS t, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY entity ORDER BY ts, obs) AS gap FROM obs) SELECT entity, round(max(t) - min(t), 3) AS span_s, round(coalesce(avg(gap) * 1000, 0), 2) AS mean_gap_ms FROM g GROUP BY 1")
def w09(spark, d):
    return r(r(correlation.propagation_gaps(P.telemetry(spark, d)), 3, "span_s"), 2, "mean_gap_ms")


@query("j16_wallet_links", """WITH o AS (SELECT l_orderkey AS tx, l_suppkey AS src, l_partkey AS dst, l_linenumber AS n FROM lineitem), f AS (SELECT tx, arg_min(src, (n, src)) AS origin FROM o GROUP BY 1), e AS (SELECT DISTINCT tx, ip FROM (SELECT tx, src AS ip FROM o UNION ALL SELECT tx, dst FROM o))
 SELECT o_custkey AS wallet, e.tx, ip, CASE WHEN ip = origin THEN 'ORIGIN' ELSE 'RELAY' END AS role FROM e JOIN f ON f.tx = e.tx JOIN orders ON o_orderkey = e.tx""")
def j16(spark, d):
    obs = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tx"), F.col("l_suppkey").alias("src_ip"), F.col("l_partkey").alias("dst_ip"), F.col("l_linenumber").alias("ts"), F.col("l_suppkey").alias("obs"))
    inputs = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("wallet"))
    return correlation.wallet_links(inputs, correlation.tx_ips(obs))


@query("r05_filtered_page", "WITH " + ALERTS + " SELECT entity, score FROM (SELECT * FROM alerts WHERE score >= 20 AND is_synthetic ORDER BY CASE tier WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END DESC, score DESC, created_at, entity LIMIT 15 OFFSET 10)")
def r05(spark, d):
    kept = risk.filter_alerts(alerts(spark, d).where("is_synthetic"), min_score=20.0)
    return risk.triage(kept, 15, 10).select("entity", "score")


@query("g31_first_nodes", "WITH RECURSIVE " + P.OWNERSHIP + EGO + ", fi AS (SELECT node FROM ego ORDER BY hops, node LIMIT 12) SELECT src, dst FROM own WHERE src IN (FROM fi) AND dst IN (FROM fi)")
def g31(spark, d):
    own = stash(P.ownership(spark, d), "own")
    both = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hub = both.distinct().groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").first()["src"]
    return graph.first_nodes(own, hub, 3, 12)[1].select("src", "dst")


def _sink(spark, d, kind, write):
    path = f"{run_dir(spark)}/sink-{uuid.uuid4().hex}.{kind}"
    write(P.table(spark, d, "customer").select("c_custkey", F.array(F.col("c_nationkey").cast("bigint"), F.col("c_custkey") % 3).alias("parts")), path)
    return path


@query("s13_csv_lists", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '[' || c_nationkey || ',' || c_custkey % 3 || ']' AS parts FROM customer")
def s13(spark, d):
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(_sink(spark, d, "csv", raw.write_csv)).select("c_custkey", "parts")


@query("s14_json_records", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS first, c_custkey % 3 AS last FROM customer")
def s14(spark, d):
    rows = spark.read.json(_sink(spark, d, "jsonl", raw.write_json))
    return rows.select("c_custkey", F.col("parts")[0].alias("first"), F.col("parts")[1].alias("last"))


@query("s15_xml_records", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS first, c_custkey % 3 AS last FROM customer")
def s15(spark, d):
    rows = spark.read.format("xml").option("rowTag", "transaction").load(_sink(spark, d, "xml", raw.write_xml))
    return rows.select("c_custkey", F.col("parts")[0].alias("first"), F.col("parts")[1].alias("last"))
