"""Queries of the remaining projections, joins, windows, evidence, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnflow.durable import run_dir
from cairnflow.functions import scalars as S
from cairnflow.operators import correlation, entities, evidence, flatten, graph, heuristics, ingest, ml, risk
from cairnflow.plans import projections as P
from cairnflow.plans.q_flow import FANS, LIFE, MEMBER, WP, Book, W
from cairnflow.plans.q_graph import EDGES, trade, typed_edges
from cairnflow.plans.q_risk import SCORED, scored
from cairnflow.plans.registry import query
from cairnflow.sources import raw


def _nested(spark, d):
    return flatten.nest_sides(P.payments(spark, d).outputs, "tx_idx", "addrs", "amounts")


def _file(spark, kind):
    return f"{run_dir(spark)}/file-{uuid.uuid4().hex}.{kind}"


NESTED = W + " SELECT tx_idx, string_agg(CAST(addr AS VARCHAR), ',' ORDER BY pos) AS addrs, count(*) AS n FROM outputs WHERE tx_idx < 300 GROUP BY 1"


def _back(df):
    return df.select(F.col("tx_idx").cast("bigint").alias("tx_idx"), F.array_join(S.parse_list(F.col("addrs")), ",").alias("addrs"), F.size(S.parse_numbers(F.col("amounts"))).cast("bigint").alias("n"))


NESTED_WHOLE = NESTED.replace(" WHERE tx_idx < 300", "")


def _round_trip(spark, d, kind, write):
    """All transactions, written and read back."""
    path = _file(spark, kind)
    write(_nested(spark, d), path)
    return _back(raw.read_raw(spark, path))


@query("s01_csv_round_trip_whole", NESTED_WHOLE)
def s01_whole(spark, d):
    return _round_trip(spark, d, "csv", raw.write_csv)


@query("s02_json_lines_round_trip_whole", NESTED_WHOLE)
def s02_whole(spark, d):
    return _round_trip(spark, d, "jsonl", raw.write_json)


@query("s04_xml_round_trip_whole", NESTED_WHOLE)
def s04_whole(spark, d):
    return _round_trip(spark, d, "xml", raw.write_xml)


# These write and read the whole table as well; their SQL holds the first transactions, so only those are returned.
@query("s01_csv_round_trip", NESTED)
def s01(spark, d):
    return s01_whole(spark, d).where("tx_idx < 300")


@query("s02_json_lines_round_trip", NESTED)
def s02(spark, d):
    return s02_whole(spark, d).where("tx_idx < 300")


@query("s04_xml_round_trip", NESTED)
def s04(spark, d):
    return s04_whole(spark, d).where("tx_idx < 300")


@query("s12_line_list", "SELECT n_name AS value FROM nation WHERE n_nationkey % 2 = 0")
def s12(spark, d):
    path = _file(spark, "list")
    n = P.table(spark, d, "nation")
    n.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), "n_name")).when(F.col("n_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("# "), "n_name")).alias("value")).write.text(path)
    return raw.read_lines(spark, path)


@query("p05_step_check", "SELECT o_orderkey % 60 BETWEEN 1 AND 49 AS ok, count(*) AS n FROM orders GROUP BY 1")
def p05(spark, d):
    step = (F.col("o_orderkey") % 60).cast("string").try_cast("int")
    return P.table(spark, d, "orders").groupBy(step.between(1, 49).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("p09_scripts", "SELECT coalesce(nullif(upper(trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' WHEN o_orderkey % 7 <> 0 THEN lower(o_orderstatus) || ' ' END)), ''), 'UNKNOWN') AS script, count(*) AS n FROM orders GROUP BY 1")
def p09(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 5 == 0, " ").when(k % 7 != 0, F.concat(F.lower("o_orderstatus"), F.lit(" ")))
    return P.table(spark, d, "orders").groupBy(ingest.clean_script(s).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_labelled_rows", "SELECT d.doc_id, source, coalesce(toxic, 3) AS class FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def p11(spark, d):
    return P.table(spark, d, "documents").select("doc_id", "source").join(P.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", "source", F.coalesce("toxic", F.lit(3)).alias("class"))


@query("p12_edge_normalise", "WITH " + EDGES + " SELECT src, dst, relationship, false AS is_synthetic, CAST(1.0 AS DOUBLE) AS confidence, 'import' AS provenance FROM edges")
def p12(spark, d):
    return typed_edges(spark, d)


@query("p17_hubs", "WITH RECURSIVE " + P.PAYMENTS + MEMBER + """, p AS (SELECT DISTINCT src, dst FROM flow), o AS (SELECT src AS entity, count(*) AS o FROM p GROUP BY 1), i AS (SELECT dst AS entity, count(*) AS i FROM p GROUP BY 1), n AS (SELECT entity, count(*) AS n FROM member GROUP BY 1)
 SELECT n.entity FROM n LEFT JOIN o ON o.entity = n.entity LEFT JOIN i ON i.entity = n.entity WHERE (coalesce(i, 0) >= 120 AND coalesce(o, 0) >= 110) OR n >= 50""")
def p17(spark, d):
    from cairnflow.config import GraphConfig

    b = Book(spark, d)
    return risk.hubs(entities.degrees(b.flow), b.member.groupBy("entity").agg(F.count(F.lit(1)).alias("n_addresses")), GraphConfig(hub_in=120, hub_out=110))


@query("p18_active", W + MEMBER + " SELECT entity FROM (SELECT entity FROM sent UNION ALL SELECT entity FROM recv) GROUP BY 1 HAVING count(*) >= 150")
def p18(spark, d):
    b = Book(spark, d)
    return b.sent.select("entity").unionByName(b.recv.select("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n >= 150").select("entity")


@query("p20_binary_target", "SELECT doc_id, CASE WHEN quality + toxic = 1 THEN 1 ELSE 0 END AS target FROM labels WHERE quality + toxic IN (1, 2)")
def p20(spark, d):
    c = F.col("quality") + F.col("toxic")
    return P.table(spark, d, "labels").where(c.isin(1, 2)).select("doc_id", F.when(c == 1, 1).otherwise(0).alias("target"))


@query("j04_reindex", "SELECT c_custkey, coalesce(s, 0) AS spent, coalesce(n, -1) AS last_order FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS s, max(o_orderkey) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j04(spark, d):
    o = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.max("o_orderkey").alias("last_order"))
    return P.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna({"spent": 0.0, "last_order": -1})


@query("j05_gather", W + " SELECT i.tx_idx, tx.ts, addr FROM inputs i JOIN tx ON tx.tx_idx = i.tx_idx")
def j05(spark, d):
    b = Book(spark, d)
    return b.inputs.join(b.tx.select("tx_idx", "ts"), "tx_idx").select("tx_idx", "ts", "addr")


@query("j08_pool_pairs", WP + FANS + """, i AS (SELECT DISTINCT tx_idx, addr AS src FROM inputs JOIN pool USING (tx_idx) WHERE is_pool), pr AS (SELECT i.tx_idx, src, addr AS dst, amount, pos FROM i JOIN outputs o ON o.tx_idx = i.tx_idx WHERE src <> addr)
 SELECT tx_idx, count(*) AS n_pairs, count(DISTINCT src) AS n_src FROM pr GROUP BY 1""")
def j08(spark, d):
    b = Book(spark, d, pooled=True)
    own = b.inputs.select("addr").union(b.outputs.select("addr")).distinct().withColumn("entity", F.col("addr"))
    pooled = b.pool.where("is_pool").select("tx_idx")
    into = b.inputs.join(pooled, "tx_idx", "left_semi").join(own, "addr").select("tx_idx", F.col("entity").alias("src")).distinct()
    pairs = into.join(b.outputs.select("tx_idx", F.col("addr").alias("dst")), "tx_idx").where("src <> dst")
    per = pairs.groupBy("tx_idx", "src").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("tx_idx").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_src"))


@query("j12_octet", "SELECT event_id, CASE WHEN user_id % 256 BETWEEN 10 AND 49 THEN 'A' WHEN user_id % 256 BETWEEN 50 AND 99 THEN 'B' ELSE '' END AS zone FROM events")
def j12(spark, d):
    zones = spark.createDataFrame([(10, 49, "A"), (50, 99, "B")], "start bigint, end bigint, zone string").withColumn("octet", F.explode(F.sequence("start", "end"))).select("octet", "zone")
    e = P.table(spark, d, "events").select("event_id", (F.col("user_id") % 256).alias("octet"))
    return e.join(F.broadcast(zones), "octet", "left").select("event_id", F.coalesce("zone", F.lit("")).alias("zone"))


@query("j15_frontier", "WITH f AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 100 = 1) SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM f) OR o_orderkey % 500 = 3")
def j15(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    front = o.where("o_orderkey % 100 = 1").select("o_custkey").distinct()
    return o.join(front, "o_custkey", "left_semi").select("o_orderkey").unionByName(o.where("o_orderkey % 500 = 3").select("o_orderkey")).distinct()


@query("j17_obs_tx", "SELECT event_id, c_nationkey FROM events JOIN customer ON c_custkey = user_id")
def j17(spark, d):
    return P.table(spark, d, "events").select("event_id", F.col("user_id").alias("c_custkey")).join(P.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("event_id", "c_nationkey")


@query("e06_first_obs_flags", "WITH " + P.TELEMETRY + " SELECT entity, arg_min(country, ts) AS country, arg_min(ip, ts) % 4 = 0 AS listed FROM obs GROUP BY 1")
def e06(spark, d):
    first = flatten.first_observations(P.telemetry(spark, d), "entity", "ts", "obs")
    return first.select("entity", "country", (F.col("ip") % 4 == 0).alias("listed"))


@query("e07_sender", WP + " SELECT tx_idx, arg_min(addr, pos) AS sender FROM inputs GROUP BY 1")
def e07(spark, d):
    return entities.first_inputs(Book(spark, d, pooled=True).inputs)


@query("e18_active_hours", W + MEMBER + " SELECT entity, round((max(ts) - min(ts)) / 3600, 4) AS active_hours, count(*) AS n FROM (SELECT entity, tx_idx FROM sent UNION SELECT entity, tx_idx FROM recv) JOIN tx USING (tx_idx) GROUP BY 1")
def e18(spark, d):
    return Book(spark, d).events.groupBy("entity").agg(F.round((F.max("ts") - F.min("ts")) / 3600, 4).alias("active_hours"), F.count(F.lit(1)).alias("n"))


@query("g04_indicator", W + LIFE + " SELECT tx_idx, n_out = 1 AND first_spend_tx >= 0 AS hit FROM tx JOIN inputs USING (tx_idx) JOIN life USING (addr)")
def g04(spark, d):
    b = Book(spark, d)
    return b.tx.join(b.inputs.select("tx_idx", "addr"), "tx_idx").join(b.life, "addr").select("tx_idx", ((F.col("n_out") == 1) & (F.col("first_spend_tx") >= 0)).alias("hit"))


@query("g13_node_info", "WITH trade_nodes AS (SELECT n_nationkey AS node FROM nation) SELECT CAST(node AS BIGINT) AS node, n_name AS name, r_name AS region FROM trade_nodes JOIN nation ON n_nationkey = node JOIN region ON r_regionkey = n_regionkey")
def g13(spark, d):
    n, g = P.table(spark, d, "nation"), P.table(spark, d, "region")
    return n.join(g, n.n_regionkey == g.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("node"), F.col("n_name").alias("name"), F.col("r_name").alias("region"))


@query("g18_by_relationship", "WITH " + EDGES + " SELECT src, dst FROM edges WHERE relationship = 'part_of'")
def g18(spark, d):
    return typed_edges(spark, d).where("relationship = 'part_of'").select("src", "dst")


@query("g24_node_features", "WITH " + EDGES + " SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) WHERE node LIKE 'n%' GROUP BY 1")
def g24(spark, d):
    return graph.degree_features(typed_edges(spark, d)).where(F.col("node").startswith("n")).select("node", "in_degree", "out_degree")


@query("g21_betweenness")
def g21(spark, d):
    return graph.betweenness(trade(spark, d).where("(src * 3 + dst) % 4 = 0 and src <> dst"))


@query("w01_gaps", "WITH " + P.TELEMETRY + " SELECT obs, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY entity ORDER BY ts) AS gap_us FROM obs")
def w01(spark, d):
    t = F.unix_micros("ts")
    return P.telemetry(spark, d).select("obs", (t - F.lag(t).over(Window.partitionBy("entity").orderBy("ts", "obs"))).alias("gap_us"))


@query("w05_distinct_count", "SELECT o_orderkey, n FROM orders JOIN (SELECT o_custkey AS c, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) ON c = o_custkey")
def w05(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    n = o.select("o_custkey", "o_orderpriority").distinct().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return o.join(n, "o_custkey").select("o_orderkey", "n")


@query("w06_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM orders")
def w06(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return P.table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("so_far"))


LEDGER = ", le AS (SELECT *, [x FOR x IN [CASE WHEN ml >= 0.4 THEN 'model' END, CASE WHEN anomaly >= 0.4 THEN 'anomaly' END, CASE WHEN graph > 0 THEN 'structure' END, CASE WHEN correlation >= 0.4 THEN 'network' END, CASE WHEN known > 0 THEN 'known' END, CASE WHEN (coalesce(ml, 0) >= 0.6 AND (coalesce(graph, 0) >= 0.5 OR coalesce(anomaly, 0) >= 0.6 OR coalesce(known, 0) >= 0.5)) OR (coalesce(anomaly, 0) >= 0.6 AND coalesce(ml, 0) < 0.4 AND coalesce(graph, 0) < 0.4 AND coalesce(known, 0) < 0.4) THEN 'synthesis' END] IF x IS NOT NULL] AS cats FROM scored)"


@query("k10_ledger", "WITH " + SCORED + LEDGER + " SELECT entity, array_to_string(cats, ',') AS categories, len(cats) AS n FROM le")
def k10(spark, d):
    out = evidence.ledger(scored(spark, d))
    return out.select("entity", F.array_join(F.transform("ledger", lambda x: x["category"]), ",").alias("categories"), F.size("ledger").cast("bigint").alias("n"))


@query("k09_alerts", "WITH " + SCORED + " SELECT sha256('entity:' || entity)[1:16] AS alert_id, entity, score, tier, 'new' AS status, is_synthetic FROM scored WHERE score >= 40")
def k09(spark, d):
    return evidence.alerts(scored(spark, d)).drop("headline")


@query("a11_heuristic_hits", WP + FANS + """, m AS (SELECT DISTINCT addr % 40 AS entity, tx_idx FROM inputs), h AS (SELECT tx_idx, unnest([x FOR x IN [CASE WHEN consolidation THEN 'consolidation' END, CASE WHEN batch_payout THEN 'batch_payout' END] IF x IS NOT NULL]) AS heuristic FROM fan)
 SELECT entity, heuristic, count(*) AS n, min(h.tx_idx) AS first_tx FROM m JOIN h ON h.tx_idx = m.tx_idx GROUP BY 1, 2""")
def a11(spark, d):
    b = Book(spark, d, pooled=True)
    sent = b.inputs.select((F.col("addr") % 40).alias("entity"), "tx_idx").distinct()
    return evidence.heuristic_hits(sent, heuristics.fans(b.tx, b.pool, heuristics.dust(b.tx, b.outputs, b.c), b.c))


@query("x01_seed_evidence", "WITH " + SCORED + ", v AS (SELECT entity, entity % 6 - 1 AS hops, entity * 3 AS nearest, score FROM scored) SELECT entity, CASE WHEN hops >= 0 THEN hops END AS hops, CASE WHEN hops > 0 THEN nearest END AS nearest, CAST(1.5 AS DOUBLE) AS boost FROM v")
def x01(spark, d):
    k = F.col("entity")
    return evidence.seed_evidence(scored(spark, d).withColumns({"hops": k % 6 - 1, "nearest": k * 3, "score_base": F.col("score") - 1.5}))


@query("x02_addresses", W + MEMBER + " SELECT entity, count(*) AS n_addresses, array_to_string((list(addr ORDER BY addr))[1:2], ',') AS addresses FROM member GROUP BY 1")
def x02(spark, d):
    return evidence.address_heads(Book(spark, d).member, 2)


@query("x03_status", "WITH " + SCORED + " SELECT count(*) AS n_entities, count(*) FILTER (WHERE score > 0) AS n_scored, count(*) FILTER (WHERE score >= 40) AS n_alerts, count(*) FILTER (WHERE entity % 97 = 0) AS n_seeds FROM scored")
def x03(spark, d):
    return scored(spark, d).agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(F.col("score") > 0).alias("n_scored"), F.count_if(F.col("score") >= 40).alias("n_alerts"), F.count_if(F.col("entity") % 97 == 0).alias("n_seeds"))


@query("x16_five_numbers", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice) + 1e-7, 4) AS mean, round(quantile_cont(o_totalprice, 0.5) + 1e-7, 4) AS median FROM orders GROUP BY 1")
def x16(spark, d):
    x = "o_totalprice"
    return P.table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum(x), 2).alias("total"), F.min(x).alias("min"), F.max(x).alias("max"), F.round(F.avg(x) + 1e-7, 4).alias("mean"), F.round(F.percentile(x, F.lit(0.5)) + 1e-7, 4).alias("median"))


@query("c03_temporal", "SELECT event_id, epoch(ts) >= 1704672000 AND epoch(ts) < 1705276800 AS inside FROM events")
def c03(spark, d):
    return P.table(spark, d, "events").select("event_id", S.in_window(F.col("ts").cast("timestamp").cast("double"), F.lit(1704672000), F.lit(1705276800)).alias("inside"))


@query("c02_ip_tx", "WITH o AS (SELECT user_id % 50 AS tx, event_id % 23 AS ip FROM events UNION SELECT user_id % 50, event_id % 19 FROM events) SELECT DISTINCT tx FROM o WHERE ip = 7")
def c02(spark, d):
    from cairnflow.plans.q_risk import hops_of

    return correlation.tx_ips(hops_of(spark, d)).where("ip = 7").select("tx")


@query("f14_humanize", "SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%.0f s', s) WHEN s < 3600 THEN printf('%.1f min', s / 60) WHEN s < 86400 THEN printf('%.1f h', s / 3600) ELSE printf('%.1f d', s / 86400) END AS t FROM (SELECT o_orderkey, CAST(o_orderkey * 64 AS DOUBLE) AS s FROM orders)")
def f14(spark, d):
    return P.table(spark, d, "orders").select("o_orderkey", S.humanize((F.col("o_orderkey") * 64).cast("double")).alias("t"))


@query("f19_rule_score", "SELECT o_orderkey, round((CAST(o_totalprice > 100000 AS INTEGER) + CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderstatus = 'F' AS INTEGER) + CAST(o_custkey < 500 AS INTEGER) + CAST(o_orderpriority LIKE '1%' AS INTEGER)) / 5, 6) AS rule FROM orders")
def f19(spark, d):
    return P.table(spark, d, "orders").select("o_orderkey", F.round(ml.rule_score(F.col("o_totalprice") > 100000, F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus") == "F", F.col("o_custkey") < 500, F.col("o_orderpriority").startswith("1")), 6).alias("rule"))


@query("f22_amounts", "SELECT n_nationkey, printf('%.8f', n_nationkey * 0.125) AS amount FROM nation")
def f22(spark, d):
    return P.table(spark, d, "nation").select("n_nationkey", F.format_string("%.8f", F.col("n_nationkey") * 0.125).alias("amount"))


@query("m04_interval")
def m04(spark, d):
    rows = ml.vectors(P.table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label") == 0)
    return ml.tree_spread(ml.forest(rows, 10), rows)


@query("m05_occlusion")
def m05(spark, d):
    rows = P.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), ((F.col("c_acctbal") > 5000) & (F.col("c_nationkey") < 15)).cast("double").alias("label"))
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=["c_acctbal", "nation"], outputCol="features").transform(rows)
    mid = rows.agg(F.percentile("c_acctbal", F.lit(0.5)), F.percentile("nation", F.lit(0.5))).first()
    return ml.occlusion(ml.forest(x, 10), x, [mid[0], mid[1]], ["balance", "nation"])


@query("m19_logistic")
def m19(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = ml.vectors(P.table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label") == 0)
    return ml.logistic(rows).transform(rows).select("id", vector_to_array("probability")[1].alias("p"))


@query("s21_synthetic")
def s21(spark, d):
    from cairnflow.sources import synth

    return synth.payments(spark, synth.SynthConfig(n_tx=1000)).select("txid", "kind", "fee")


@query("s22_observations")
def s22(spark, d):
    from cairnflow.sources import synth

    return synth.observations(synth.payments(spark, synth.SynthConfig(n_tx=200)))

