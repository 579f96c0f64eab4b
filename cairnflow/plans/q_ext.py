"""Queries of column names and units, sources with schemas, saved models, generators, graph views and scores."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cairnflow.config import FORENSIC, GraphConfig
from cairnflow.durable import run_dir, stash
from cairnflow.functions import scalars as S
from cairnflow.operators import chains, correlation, detect, entities, evidence, graph, heuristics, ingest, risk
from cairnflow.plans import projections as P
from cairnflow.plans import report, views
from cairnflow.plans.q_flow import CHAIN, CHANGE, EVENTS, HOPS, LIFE, MEMBER, PEEL, Book, W, r
from cairnflow.plans.q_graph import ADJ, TRADE, trade, typed_edges
from cairnflow.plans.q_more import LEDGER
from cairnflow.plans.q_risk import SCORED, scored
from cairnflow.plans.registry import query
from cairnflow.sources import models, raw, strict, synth


def _folder(spark, name):
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _aliased(spark, d):
    """Orders as raw strings under other names."""
    o, k = P.table(spark, d, "orders"), F.col("o_orderkey")
    pair = lambda a, b: F.concat_ws("|", a.cast("string"), b.cast("string"))
    return o.select(
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string").alias(" Block_Time"), k.cast("string").alias("TxHash"), F.col("o_custkey").cast("string").alias("input_wallets"), pair(k % 100, k % 7).alias("output_addrs"),
        F.lit("12.5").alias("input_values"), F.lit("7|5").alias("output_values"), F.lit("0.5").alias("fee_btc"), F.lit("p2pkh").alias("script"), F.lit("DE").alias("geo"), F.lit("10.0.0.1").alias("src_address"), F.lit("8333").alias("dest_port"), F.lit("own").alias("note"),
    )


@query("p01_aliases", """SELECT CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS timestamp, CAST(o_orderkey AS VARCHAR) AS txid, CAST(o_custkey AS VARCHAR) AS input_addresses, o_orderkey % 100 || '|' || o_orderkey % 7 AS output_addresses, '12.5' AS input_amounts, '7|5' AS output_amounts,
 '0.5' AS fee, 'p2pkh' AS script_type, 'DE' AS geo_country, '10.0.0.1' AS src_ip, '8333' AS dst_port, 'own' AS note FROM orders""")
def p01(spark, d):
    out, _ = ingest.canonical(_aliased(spark, d))
    return out.select("timestamp", "txid", "input_addresses", "output_addresses", "input_amounts", "output_amounts", "fee", "script_type", "geo_country", "src_ip", "dst_port", "note")


@query("p02_optional_columns", "SELECT CAST(o_orderkey AS VARCHAR) AS txid, '' AS dst_ip, CAST(NULL AS VARCHAR) AS src_port, CAST(NULL AS VARCHAR) AS asn FROM orders")
def p02(spark, d):
    return ingest.canonical(_aliased(spark, d))[0].select("txid", "dst_ip", "src_port", "asn")


@query("p03_column_unit", "SELECT o_orderkey AS k, round(CASE WHEN o_orderkey % 10 < 7 THEN 1600000000000 + o_orderkey ELSE 50000000000 + o_orderkey END / 1000, 3) AS seconds FROM orders")
def p03(spark, d):
    k = F.col("o_orderkey")
    rows = P.table(spark, d, "orders").select(k.alias("k"), F.when(k % 10 < 7, F.lit(1_600_000_000_000) + k).otherwise(F.lit(50_000_000_000) + k).cast("string").alias("timestamp"))
    return rows.select("k", F.round(S.parse_time(F.col("timestamp"), ingest.epoch_unit(rows)), 3).alias("seconds"))


@query("p13_observations", "SELECT event_id AS tx, epoch(ts) AS ts, '10.0.0.' || user_id % 250 AS src_ip, '' AS dst_ip, 8333 AS src_port, CAST(NULL AS INTEGER) AS dst_port, upper(event_type) AS country, CAST(0 AS BIGINT) AS asn, true AS is_synthetic FROM events")
def p13(spark, d):
    e = P.table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("tx"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.concat(F.lit(" 10.0.0."), F.col("user_id") % 250).alias("src_ip"), F.lit(None).cast("string").alias("dst_ip"), F.lit("8333").alias("src_port"), F.lit("x").alias("dst_port"), F.col("event_type").alias("country"), F.lit(None).cast("string").alias("asn"), F.lit(False).alias("is_synthetic"))
    return correlation.normalised(rows)


@query("p22_forensic_chips", """WITH c AS (SELECT c_custkey AS entity, c_custkey AS k FROM customer) SELECT entity, array_to_string([x FOR x IN [CASE WHEN k % 2 = 0 THEN 'peel chain' END, CASE WHEN k % 3 = 0 THEN 'rapid-hop layering' END, CASE WHEN k % 5 = 0 THEN 'dust spray' END, CASE WHEN k % 7 = 0 THEN 'CoinJoin' END,
 CASE WHEN k % 4 >= 1 THEN 'Tor origin' END, CASE WHEN k % 8 >= 2 THEN 'hosting/VPN origin' END, CASE WHEN k % 6 = 0 AND k % 11 > 0 THEN 'pass-through' END, CASE WHEN k % 9 BETWEEN 1 AND 3 THEN 'uniform inbound amounts' END, CASE WHEN k % 20 >= 10 THEN 'consolidation' END,
 CASE WHEN k % 97 = 0 THEN 'seed (known illicit)' WHEN k % 13 <> 0 AND k % 5 = 1 THEN '1 hop from seed' WHEN k % 13 <> 0 AND k % 5 = 2 THEN '2 hops from seed' END] IF x IS NOT NULL], ', ') AS chips FROM c""")
def p22(spark, d):
    k = F.col("entity")
    rows = P.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    hit = lambda n: (k % n == 0).cast("int")
    rows = rows.withColumns({
        "peel_chain_txs": hit(2), "layering_chain_txs": hit(3), "dust_spray_txs": hit(5), "coinjoin_txs": hit(7), "tor_share": k % 4 * 0.25, "vpn_share": k % 8 * 0.125, "pass_through_ratio": F.when(k % 6 == 0, 0.97).otherwise(0.5), "n_sent_txs": F.lit(3),
        "n_recv_txs": k % 11, "recv_amount_cv": k % 9 * 0.06 - 0.05, "max_n_in_sent": k % 20, "is_seed": k % 97 == 0, "seed_hops": (k % 5).cast("int"), "seed_risk": F.when(k % 13 == 0, 0.0).otherwise(0.3),
    })
    return rows.select("entity", F.array_join(risk.forensic_chips(), ", ").alias("chips"))


@query("s03_wrapped_json", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def s03(spark, d):
    at = _folder(spark, "wrapped") + ".json"
    item = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    P.table(spark, d, "nation").agg(F.to_json(F.struct(F.lit("v1").alias("version"), F.collect_list(item).alias("records"))).alias("value")).write.text(at)  # 25 nations
    return raw.read_raw(spark, at).select("id", "name")


@query("s05_file_errors", "SELECT 'missing' AS what, 'AnalysisException' AS error UNION ALL SELECT 'unsupported', 'ValueError'")
def s05(spark, d):
    out = []
    for what, path in (("missing", f"{run_dir(spark)}/no-such-file.csv"), ("unsupported", f"{d}/nation.docx")):
        try:
            raw.read_raw(spark, path).count()
        except Exception as e:  # noqa: BLE001  the kind of error is the result
            out.append((what, type(e).__name__))
    return spark.createDataFrame(out, "what string, error string")


def _strict_files(spark, d, *names):
    """The strict files of these names (all eight, if none), made of orders, customers and payments."""
    at, k = _folder(spark, "strict"), F.col("o_orderkey")
    o, c = P.table(spark, d, "orders"), P.table(spark, d, "customer")
    b = P.payments(spark, d)
    w, name = F.concat(F.lit("w"), F.col("c_custkey")), lambda x: F.concat(F.lit("w"), F.col(x))
    tx = b.tx.select("tx_idx", F.col("txid").alias("txId"))
    frames = {
        "txs_features": o.select(k.alias("txId"), (k % 49 + 1).alias("Time step"), *[((k * (i + 1)) % 97 / 4).alias(n) for i, n in enumerate((*detect.ANONYMOUS, *detect.INTERPRETABLE))]),
        "txs_classes": o.select(k.alias("txId"), (k % 3 + 1).alias("class")),
        "wallets_features": c.select(w.alias("address"), (F.col("c_custkey") % 49 + 1).alias("Time step"), F.lit(1.0).alias("num_txs_as_sender"), F.lit(2.0).alias("num_txs_as receiver"), *[(F.col("c_custkey") % (i + 2) * 1.0).alias(f"x{i}") for i in range(53)]),
        "wallets_classes": c.select(w.alias("address"), (F.col("c_custkey") % 3 + 1).alias("class")),
        "txs_edgelist": b.tx.select(F.col("txid").alias("txId1"), (F.col("txid") + 1).alias("txId2")),
        "addr_tx_edgelist": b.inputs.join(tx, "tx_idx").select(name("addr").alias("input_address"), "txId"),
        "tx_addr_edgelist": b.outputs.join(tx, "tx_idx").select("txId", name("addr").alias("output_address")),
        "addr_addr_edgelist": b.inputs.select("tx_idx", name("addr").alias("input_address")).join(b.outputs.select("tx_idx", name("addr").alias("output_address")), "tx_idx").select("input_address", "output_address"),
    }
    for n in names or frames:
        frames[n].write.option("header", True).csv(f"{at}/{strict.SPECS[n].file}")
    return at


@query("s06_strict_csv", "SELECT o_orderkey % 49 + 1 AS time_step, count(*) AS n, round(sum((o_orderkey % 97) / 4), 4) AS first, round(sum(((o_orderkey * 182) % 97) / 4), 4) AS last FROM orders GROUP BY 1")
def s06(spark, d):
    rows = strict.read_typed(spark, f"{_strict_files(spark, d, 'txs_features')}/txs_features.csv", strict.SPECS["txs_features"])
    return rows.groupBy("time_step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("Local_feature_1"), 4).alias("first"), F.round(F.sum("out_BTC_total"), 4).alias("last"))


@query("s07_renames", "SELECT 'w' || c_custkey AS address, c_custkey % 49 + 1 AS time_step, CAST(2.0 AS DOUBLE) AS num_txs_as_receiver FROM customer")
def s07(spark, d):
    rows = strict.read_typed(spark, f"{_strict_files(spark, d, 'wallets_features')}/wallets_features.csv", strict.SPECS["wallets_features"])
    return rows.select("address", "time_step", "num_txs_as_receiver")


@query("s08_json_table", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region")
def s08(spark, d):
    at = _folder(spark, "table") + ".json"
    item = F.struct(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name"))
    P.table(spark, d, "region").agg(F.to_json(F.collect_list(item)).alias("value")).write.text(at)  # five regions
    return raw.read_table_or_object(spark, at).select("id", "name")


@query("s09_xml_table", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation")
def s09(spark, d):
    at = _folder(spark, "table") + ".xml"
    P.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.format("xml").option("rootTag", "nations").option("rowTag", "nation").save(at)
    return raw.read_xml(spark, at, "nation").select("id", "name")


@query("s10_ingest_all", "WITH " + P.PAYMENTS + """ SELECT 'txs_features' AS name, count(*) AS n, 184 AS columns FROM orders UNION ALL SELECT 'txs_classes', count(*), 2 FROM orders UNION ALL SELECT 'wallets_features', count(*), 57 FROM customer UNION ALL SELECT 'wallets_classes', count(*), 2 FROM customer
 UNION ALL SELECT 'txs_edgelist', count(*), 2 FROM tx UNION ALL SELECT 'addr_tx_edgelist', count(*), 2 FROM inputs UNION ALL SELECT 'tx_addr_edgelist', count(*), 2 FROM outputs UNION ALL SELECT 'addr_addr_edgelist', count(*), 2 FROM inputs JOIN outputs USING (tx_idx)""")
def s10(spark, d):
    out = None
    for name, rows in strict.ingest(spark, _strict_files(spark, d)).items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", F.lit(len(rows.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s11_range_files", 'SELECT 167772160 + n_nationkey * 65536 AS start, 167772160 + n_nationkey * 65536 + 65535 AS "end", n_name AS country FROM nation UNION ALL SELECT 184549376 + n_nationkey * 256, 184549376 + n_nationkey * 256 + 99, n_name FROM nation')
def s11(spark, d):
    n, at = P.table(spark, d, "nation"), _folder(spark, "ranges")
    k = F.col("n_nationkey").cast("string")
    n.select(F.concat(F.lit("10."), k, F.lit(".0.0/16")).alias("network"), F.col("n_name").alias("country")).write.option("header", True).csv(f"{at}/cidr.csv")
    n.select(F.concat(F.lit("11.0."), k, F.lit(".0")).alias("a"), F.concat(F.lit("11.0."), k, F.lit(".99")).alias("b"), F.col("n_name").alias("c")).write.csv(f"{at}/ranges.csv")
    return raw.read_ranges(spark, f"{at}/cidr.csv").unionByName(raw.read_ranges(spark, f"{at}/ranges.csv"))


@query("s17_ground_truth")
def s17(spark, d):
    at = _folder(spark, "truth")
    raw.write_truth(synth.truth(stash(synth.scenario_payments(spark, synth.ScenarioConfig(n_tx=2000)), "economy")), at)
    return spark.read.option("header", True).csv(at)


@query("s19_models", "SELECT count(*) AS n, count(*) AS same FROM customer")
def s19(spark, d):
    rows = P.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"), (F.col("c_nationkey") % 2).cast("double").alias("label"))
    at, mine = _folder(spark, "models"), None
    for version, seed in (("rf_M1_a", 1), ("rf_M1_b", 2), ("rf_M2_c", 3)):
        forest = RandomForestClassifier(numTrees=10, seed=seed, labelCol="label")
        model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), forest]).fit(rows)
        models.save(spark, at, version, model, {"feature_names": ["a", "b"]})
        mine = model.transform(rows).select("c_custkey", F.col("prediction").alias("mine")) if version == "rf_M1_b" else mine
    got, about = models.load_latest(spark, at, "rf_M1")
    if about["model_version"] != "rf_M1_b" or about["feature_names"] != ["a", "b"]:
        raise ValueError(about)
    both = got.transform(rows).select("c_custkey", "prediction").join(mine, "c_custkey")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("mine")).alias("same"))


@query("s21_scenarios")
def s21(spark, d):
    return synth.scenario_payments(spark)


@query("e02_change_links", W + LIFE + CHANGE + " SELECT DISTINCT change_addr AS src, i.addr AS dst FROM chg JOIN inputs i ON i.tx_idx = chg.tx_idx WHERE change_addr IS NOT NULL AND confidence >= 0.6")
def e02(spark, d):
    b = Book(spark, d).written()
    return entities.ownership_edges(b.tx, b.inputs, b.pool, b.changes).select("src", "dst")


def _chain_sql(links: str, tag: str) -> str:
    """CHAIN with names of its own, as a CTE list that ends in ``tag``."""
    ctes, last = CHAIN.format(links=links, least=2).rsplit("\nSELECT", 1)
    for name in ("fwd", "good", "own"):
        ctes = ctes.replace(f"{name} ", f"{name}_{tag} ").replace(f"{name}.", f"{name}_{tag}.").replace(f"{name})", f"{name}_{tag})")
    return ctes + f", {tag} AS (SELECT" + last.replace("FROM own", f"FROM own_{tag}") + ")"


@query("g04_structural", (W + LIFE + CHANGE + PEEL + HOPS).replace("WITH ", "WITH RECURSIVE ", 1) + _chain_sql("peel", "pc") + _chain_sql("layer", "lc") + MEMBER + """, du AS (SELECT o.tx_idx FROM outputs o JOIN tx ON tx.tx_idx = o.tx_idx GROUP BY o.tx_idx, n_out HAVING count(*) FILTER (WHERE amount <= 5000) >= 2 AND count(*) FILTER (WHERE amount <= 5000) >= 0.3 * n_out)
 SELECT entity AS node, CAST(max(CASE WHEN pc.tx_idx IS NOT NULL OR lc.tx_idx IS NOT NULL OR du.tx_idx IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) AS x FROM sent LEFT JOIN pc ON pc.tx_idx = sent.tx_idx LEFT JOIN lc ON lc.tx_idx = sent.tx_idx LEFT JOIN du ON du.tx_idx = sent.tx_idx GROUP BY 1""")
def g04(spark, d):
    b = Book(spark, d).written()
    life = stash(b.life, "life")
    changes = stash(heuristics.change(b.tx, b.outputs, life, b.pool, b.c), "changes")
    peels = chains.follow(heuristics.peel_links(b.tx, life, b.pool, changes, b.c), b.c.peel_min_length)
    hops = stash(heuristics.rapid_hops(b.tx, b.inputs, life, b.pool, b.c), "hops")
    layers = chains.follow(heuristics.layer_links(hops, b.tx, b.outputs, life), b.c.layer_min_length)
    dusts = heuristics.dust(b.tx, b.outputs, b.c).where("is_dust").select("tx_idx")
    one = lambda df, n: df.select("tx_idx", F.lit(1).alias(n)).distinct()
    rows = b.sent.select("entity", "tx_idx").join(one(peels, "p"), "tx_idx", "left").join(one(layers, "l"), "tx_idx", "left").join(one(dusts, "d"), "tx_idx", "left")
    counts = rows.groupBy(F.col("entity").alias("node")).agg(F.count("p").alias("peel_chain_txs"), F.count("l").alias("layering_chain_txs"), F.count("d").alias("dust_spray_txs"))
    return graph.structural_indicator(counts)


def _gated_sql(steps: int) -> str:
    """Walk, hops and gating on the trade graph with seeds 3 and 17 and hub 5."""
    s, prev = ", seed AS (SELECT 3 AS node UNION ALL SELECT 17), open AS (SELECT * FROM walk WHERE src <> 5)", "SELECT node, 0.5 AS rank FROM seed"
    for i in range(steps):
        s += f", r{i} AS ({prev})"
        prev = f"SELECT coalesce(m.node, s.node) AS node, 0.85 * coalesce(got, 0) + CASE WHEN s.node IS NULL THEN 0 ELSE 0.075 END AS rank FROM (SELECT dst AS node, sum(p * rank) AS got FROM open JOIN r{i} ON node = src GROUP BY 1) m FULL JOIN seed s ON s.node = m.node"
    s += f", final AS ({prev}), d0 AS (SELECT node, 0 AS hops, node AS nearest FROM seed)"
    for i in range(1, 5):
        s += f", d{i} AS (SELECT * FROM d{i - 1} UNION ALL SELECT dst, {i}, min(nearest) FROM open JOIN d{i - 1} ON node = src AND hops = {i - 1} WHERE dst NOT IN (SELECT node FROM d{i - 1}) GROUP BY 1)"
    return s + ", ty AS (SELECT quantile_cont(rank, 0.5) AS t FROM final WHERE node IN (SELECT node FROM seed))"


@query("g09_gating", "WITH " + TRADE + ADJ.format(flow="trade", a=3, b=4) + _gated_sql(12) + " SELECT CAST(d4.node AS BIGINT) AS node, hops, CAST(nearest AS BIGINT) AS nearest, round(CASE WHEN hops = 0 THEN 1 WHEN d4.node = 5 THEN 0 ELSE greatest(0, least(1, coalesce(rank, 0) / t)) END, 8) AS risk, hops = 0 AS is_seed FROM d4 LEFT JOIN final ON final.node = d4.node CROSS JOIN ty")
def g09(spark, d):
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "node bigint")
    return r(graph.seed_risk(trade(spark, d), one(3, 17), one(5), GraphConfig(per_source=3, per_node=4), 12), 8, "risk")


@query("g11_neighbourhood", "WITH " + TRADE.replace(" WHERE l_quantity >= 45", "") + """, s AS (SELECT src, dst, sum(amount) AS amount FROM trade GROUP BY 1, 2), n AS (SELECT node, sum(amount) AS amount FROM (SELECT dst AS node, amount FROM s WHERE src = 7 UNION ALL SELECT src, amount FROM s WHERE dst = 7 AND src <> 7) WHERE node <> 7 GROUP BY 1)
 SELECT CAST(7 AS BIGINT) AS node, 0 AS hops UNION ALL SELECT CAST(node AS BIGINT), 1 FROM (SELECT node FROM n ORDER BY amount DESC, node LIMIT 11)""")
def g11(spark, d):
    return graph.neighbourhood(graph.aggregated_edges(trade(spark, d, whole=True)), 7, 1, 12, spark.createDataFrame([(3,)], "node bigint"))


@query("g32_path_edges", "WITH n AS (SELECT n_nationkey, n_regionkey FROM nation), c AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN n ON n_nationkey = c_nationkey WHERE c_custkey = 7) SELECT 0 AS step, 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'lives_in' AS relationship, false AS is_synthetic, CAST(1.0 AS DOUBLE) AS confidence FROM c UNION ALL SELECT 1, 'n' || c_nationkey, 'r' || n_regionkey, 'part_of', false, 1.0 FROM c")
def g32(spark, d):
    region = P.table(spark, d, "customer").where("c_custkey = 7").join(P.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    return views.path(typed_edges(spark, d), "c7", f"r{region}")


@query("g33_scale_free")
def g33(spark, d):
    return graph.scale_free(spark, 20_000)


@query("g33_degree_stats", "WITH e AS (SELECT DISTINCT o_custkey AS a, o_orderkey + 1000000000 AS b FROM orders), g AS (SELECT node, count(*) AS d FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1) SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, round(avg(d), 8) AS mean_degree, max(d) AS max_degree, round(2 * (sum(d) / 2) / (count(*) * (count(*) - 1)), 10) AS density FROM g")
def g33_stats(spark, d):
    e = P.table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000).alias("dst")).distinct()
    return r(r(graph.degree_stats(e), 8, "mean_degree"), 10, "density")


@query("f11_temporal_burst", W + MEMBER + EVENTS + """, g AS (SELECT entity, ts - lag(ts) OVER (PARTITION BY entity ORDER BY ts, tx_idx) AS gap FROM ev), b AS (SELECT entity, count(*) AS n, CASE WHEN count(gap) >= 3 THEN (stddev_samp(gap) - avg(gap)) / (stddev_samp(gap) + avg(gap) + 1e-9) ELSE 0 END AS bu FROM g GROUP BY 1),
 h AS (SELECT entity, max(n) AS peak FROM (SELECT entity, floor(ts / 3600) AS hour, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1) SELECT b.entity, round(greatest(0, least(1, 0.6 * CASE WHEN n >= 5 THEN least(1, peak / 10) ELSE 0 END + 0.4 * greatest(0, bu))), 6) AS burst FROM b JOIN h ON h.entity = b.entity""")
def f11(spark, d):
    events = stash(Book(spark, d).events, "events")
    n = events.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    rows = entities.activity(events).join(entities.peak_hour(events), "entity").join(n, "entity")
    return rows.select("entity", F.round(S.temporal_burst(F.col("peak_events"), F.col("n"), F.col("burstiness")), 6).alias("burst"))


SUMMARY = SCORED + ", rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, entity) AS rank, (SELECT count(*) FROM scored) AS n FROM scored WHERE score > 0)"


@query("f15_summary", "WITH " + SUMMARY + """ SELECT entity, 'E-' || entity || ' (' || (entity % 3 + 1) || CASE WHEN entity % 3 = 0 THEN ' address) ' ELSE ' addresses) ' END || CASE WHEN entity % 97 = 0 THEN 'is a known seed (not ranked as a new lead) with' ELSE 'ranks #' || rank || ' of ' || n || ' with' END || ' priority ' || printf('%.0f', floor(score)) || '/100 (' || tier || '). Model likelihood '
 || (entity % 10 * 10) || '% (90% range ' || (entity % 10 * 5) || '%-100%).' || CASE WHEN entity % 2 = 0 THEN ' Why it was flagged: peel chain; Tor origin.' ELSE '' END || ' This is a triage lead, not proof of wrongdoing.' AS summary FROM rk""")
def f15(spark, d):
    all_rows = scored(spark, d)
    k, n = F.col("entity"), all_rows.count()
    rows = risk.rank_leads(all_rows.withColumn("is_seed", F.lit(False))).where("rank > 0").withColumns({
        "rank": F.when(k % 97 == 0, 0).otherwise(F.col("rank")), "n_ranked": F.lit(n), "n_addresses": k % 3 + 1, "score": F.floor("score").cast("double"), "p": k % 10 / 10.0, "low": k % 10 / 20.0, "high": F.lit(1.0),
        "chips": F.when(k % 2 == 0, F.array(F.lit("peel chain"), F.lit("Tor origin"))).otherwise(F.array().cast("array<string>")),
    })
    return rows.select("entity", report.lead_summary().alias("summary"))


@query("f21_escape", r"""SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM documents""")
def f21(spark, d):
    return P.table(spark, d, "documents").select("doc_id", S.escape_markup(F.coalesce("text", F.lit(""))).alias("escaped"))


@query("k06_forensic_fusion", "WITH " + P.SIGNALS + """, w AS (SELECT *, (entity % 10) / 10.0 AS net, (entity % 4) / 3.0 AS bur FROM sig), m AS (SELECT *, 100 * (coalesce(ml * 0.35, 0) + coalesce(anomaly * 0.25, 0) + coalesce(graph * 0.2, 0) + coalesce(correlation * 0.2, 0) + coalesce(known * 0.4, 0) + 0.15 * net + 0.1 * bur) /
 (CASE WHEN ml IS NULL THEN 0 ELSE 0.35 END + CASE WHEN anomaly IS NULL THEN 0 ELSE 0.25 END + CASE WHEN graph IS NULL THEN 0 ELSE 0.2 END + CASE WHEN correlation IS NULL THEN 0 ELSE 0.2 END + CASE WHEN known IS NULL THEN 0 ELSE 0.4 END + 0.25) AS raw FROM w)
 SELECT entity, round(greatest(0, least(100, CASE WHEN coalesce(ml, 0) >= 0.6 AND (coalesce(graph, 0) >= 0.5 OR coalesce(anomaly, 0) >= 0.6 OR coalesce(known, 0) >= 0.5) THEN least(100, raw * 1.15) WHEN coalesce(anomaly, 0) >= 0.6 AND coalesce(ml, 0) < 0.4 AND coalesce(graph, 0) < 0.4 AND coalesce(known, 0) < 0.4 THEN least(raw, 60) ELSE raw END)), 2) AS score FROM m""")
def k06(spark, d):
    custom = F.create_map(F.lit("network_obfuscation"), F.col("entity") % 10 / 10.0, F.lit("temporal_burst"), F.col("entity") % 4 / 3.0)
    return P.signals(spark, d).select("entity", risk.score_column("weighted", FORENSIC, custom).alias("score"))


@query("k08_tx_alerts", "WITH " + SCORED + " SELECT sha256('transaction:' || entity)[1:16] AS alert_id, entity, score, tier, 'new' AS status, is_synthetic FROM scored WHERE score >= 60")
def k08(spark, d):
    return evidence.alerts(scored(spark, d), 60.0, "transaction").drop("headline")


@query("x17_contributions", "WITH " + SCORED + LEDGER + " SELECT entity, len(cats) AS n_entries, CASE WHEN len(cats) > 3 THEN ' (+' || (len(cats) - 3) || ' more)' ELSE '' END AS more FROM le")
def x17(spark, d):
    out = evidence.ledger(scored(spark, d)).withColumn("text", evidence.narrative())
    return out.select("entity", F.size("ledger").cast("bigint").alias("n_entries"), F.regexp_extract(F.coalesce("text", F.lit("")), r"( \(\+\d+ more\))$", 1).alias("more"))


def _view_tables(spark, d):
    o, k = P.table(spark, d, "orders"), F.col("o_orderkey")
    tx = o.select(k.alias("tx"), (F.col("o_orderpriority") == "1-URGENT").alias("illicit"), F.col("o_totalprice").alias("volume"))
    scores = o.where(k % 3 == 0).select(k.alias("tx"), (k % 101).cast("double").alias("score"), S.tier((k % 101).cast("double")).alias("tier"), (k % 9 == 0).alias("is_synthetic"))
    name = lambda t, c: F.concat(F.lit(t), F.col(c))
    into = ingest.edges_of(o.select(name("c", "o_custkey").alias("s"), k.cast("string").alias("t")), "s", "t", "addr_tx")
    lines = P.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("s"), name("p", "l_partkey").alias("t"), "l_orderkey")
    out = ingest.edges_of(lines, "s", "t", "tx_addr")
    pairs = ingest.edges_of(lines.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == k).select(name("c", "o_custkey").alias("a"), "t"), "a", "t", "addr_addr")
    return tx, scores, into.unionByName(out).unionByName(pairs)


VIEW = """WITH sc AS (SELECT o_orderkey AS tx, CAST(o_orderkey % 101 AS DOUBLE) AS score, o_orderkey % 9 = 0 AS syn FROM orders WHERE o_orderkey % 3 = 0), al AS (SELECT o.o_orderkey AS tx, coalesce(score, CASE WHEN o_orderpriority = '1-URGENT' THEN 80 ELSE 10 END) AS score, coalesce(syn, false) AS syn, o_totalprice AS v FROM orders o LEFT JOIN sc ON sc.tx = o.o_orderkey),
 li AS (SELECT DISTINCT 'c' || o_custkey AS wallet, o_orderkey AS tx FROM orders UNION SELECT DISTINCT 'p' || l_partkey, l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 pa AS (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || l_partkey AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey), ot AS (SELECT a AS wallet, count(*) AS n FROM (SELECT a, b FROM pa UNION SELECT b, a FROM pa) GROUP BY 1),"""


@query("k13_wallets", VIEW + """ ag AS (SELECT wallet, count(*) AS n_txs, max(score) AS score, bool_or(syn) AS is_synthetic FROM li JOIN al ON al.tx = li.tx GROUP BY 1)
 SELECT ag.wallet, n_txs, score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS tier, 'max' AS method, coalesce(ot.n, 0) AS n_counterparties, is_synthetic FROM ag LEFT JOIN ot ON ot.wallet = ag.wallet""")
def k13(spark, d):
    tx, scores, edges = _view_tables(spark, d)
    return views.wallets(stash(edges, "edges"), tx, scores)


@query("k14_transactions", """SELECT o_orderkey AS tx, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS score, 'c' || o_custkey AS inputs, coalesce(outs, '') AS outputs, coalesce(n, 0) AS n_correlations, o_orderkey % 9 = 0 OR coalesce(syn, false) AS is_synthetic
 FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(p, ',' ORDER BY p) AS outs FROM (SELECT DISTINCT l_orderkey, 'p' || l_partkey AS p FROM lineitem) GROUP BY 1) l ON l_orderkey = o_orderkey LEFT JOIN (SELECT event_id AS tx, count(*) AS n, bool_or(user_id % 2 = 0) AS syn FROM events GROUP BY 1) e ON e.tx = o_orderkey""")
def k14(spark, d):
    tx, scores, edges = _view_tables(spark, d)
    found = P.table(spark, d, "events").select(F.col("event_id").alias("tx"), (F.col("user_id") % 2 == 0).alias("is_synthetic"))
    out = views.transactions(tx.select("tx"), stash(edges, "edges"), scores, found)
    return out.select("tx", "score", F.array_join("inputs", ",").alias("inputs"), F.array_join("outputs", ",").alias("outputs"), "n_correlations", "is_synthetic")


@query("x15_single_node", "SELECT 'c7' AS node, CAST(0 AS BIGINT) AS in_degree, 1 + (SELECT count(*) FROM orders WHERE o_custkey = 7) AS out_degree")
def x15(spark, d):
    return graph.degree_features(graph.incident(typed_edges(spark, d), "c7")).where("node = 'c7'").select("node", "in_degree", "out_degree")


@query("x21_time_steps", "SELECT i AS step, CAST(DATE '2019-01-07' + CAST((i - 1) * 14 AS INTEGER) AS DATE) AS first, CAST(DATE '2019-01-07' + CAST(i * 14 AS INTEGER) AS DATE) AS next FROM generate_series(1, 49) t(i)")
def x21(spark, d):
    start, end = S.window_of_step(F.col("id"))
    return spark.range(1, 50).select(F.col("id").alias("step"), start.alias("first"), end.alias("next"))


@query("x20_country_filter", "SELECT c_custkey AS peer, 'N' || c_nationkey AS country, 'N3' AS asked FROM customer WHERE c_nationkey = 3 OR NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 3) UNION ALL SELECT c_custkey, 'N' || c_nationkey, 'N99' FROM customer")
def x20(spark, d):
    peers = P.table(spark, d, "customer").select(F.col("c_custkey").alias("peer"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("country"))
    return synth.concentrated(peers, "N3").withColumn("asked", F.lit("N3")).unionByName(synth.concentrated(peers, "N99").withColumn("asked", F.lit("N99")))
