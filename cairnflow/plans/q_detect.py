"""Queries of the detectors, their evaluation and the experiments on leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.config import ForensicsConfig
from cairnflow.durable import stash
from cairnflow.functions import scalars as S
from cairnflow.operators import detect, ml
from cairnflow.plans import benchmark, forensics
from cairnflow.plans import projections as P
from cairnflow.plans.q_flow import r
from cairnflow.plans.q_risk import CURVE, TRUTH, truth
from cairnflow.plans.registry import query


@query("m07_campaign_folds", "SELECT c_custkey AS entity, CAST(CAST('0x' || substring(md5(CASE WHEN c_custkey % 4 = 0 THEN 'c' || c_nationkey ELSE 'e' || c_custkey END), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM customer")
def m07(spark, d):
    rows = P.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).otherwise(-1).alias("campaign"))
    return ml.assign_folds(rows, 5).select("entity", "fold")


@query("m14_leakage_audit", """SELECT unnest(['no_shared_steps', 'steps_in_order', 'no_forbidden_features', 'binary_target', 'no_null_target']) AS "check", unnest([true, true, false, true, true]) AS passed""")
def m14(spark, d):
    k = F.col("o_orderkey")
    rows = P.table(spark, d, "orders").select(k.alias("txId"), (k % 49 + 1).alias("time_step"), (k % 3 + 1).alias("label"))
    train, test = detect.temporal_split(rows)
    return detect.audit(train, test, ["fees", "time_step"])


@query("m15_feature_sets", "SELECT 'M1' AS name, 182 AS n, 0 AS forbidden UNION ALL SELECT 'M2', 190, 0 UNION ALL SELECT 'M3', 199, 0")
def m15(spark, d):
    rows = [(n, len(set(v)), len(detect.FORBIDDEN & set(v))) for n, v in detect.FEATURE_SETS.items()]
    return spark.createDataFrame(rows, "name string, n int, forbidden int")


def _labelled(spark, d):
    """Orders as labelled transactions: the label follows line count and quantity, with noise; steps run over 49."""
    n = P.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_out"), F.max("l_extendedprice").alias("top"), F.sum("l_extendedprice").alias("total"), F.avg("l_quantity").alias("quantity"))
    k = F.col("o_orderkey")
    odd = (F.col("n_out") >= 6) & (F.col("quantity") > 25) | (k % 37 == 0)
    return P.table(spark, d, "orders").join(n, "o_orderkey").select(
        k.alias("id"), (F.floor(k / 4) % 49 + 1).alias("time_step"), F.when(odd, 1).otherwise(2).alias("label"), F.lit(1.0).alias("num_input_addresses"), F.col("n_out").cast("double").alias("num_output_addresses"), F.col("top").alias("out_BTC_max"),
        F.col("total").alias("out_BTC_total"), (F.col("o_totalprice") / 1000).alias("total_BTC"), F.when(k % 11 != 0, F.col("quantity")).alias("fees"), (k % 5).cast("double").alias("in_txs_degree"), (k % 8).cast("double").alias("out_txs_degree"),
    )


FEATURES = ["num_output_addresses", "out_BTC_max", "out_BTC_total", "total_BTC", "fees", "in_txs_degree", "out_txs_degree"]


def _split(spark, d):
    return detect.temporal_split(stash(_labelled(spark, d), "labelled"))


@query("m12_classifier")
def m12(spark, d):
    train, test = _split(spark, d)
    return detect.evaluate(detect.train(train, FEATURES).score(test))


@query("m13_anomaly")
def m13(spark, d):
    train, test = _split(spark, d)
    out = detect.anomaly_scores(train, test, FEATURES, "id", detect.medians(train, FEATURES))
    return out.withColumn("severity", S.severity(F.col("anomaly")))


@query("m16_inference")
def m16(spark, d):
    train, test = _split(spark, d)
    return detect.infer(detect.train(train, FEATURES), test.drop("out_BTC_max", "target"), "id", "rf_M1_v1")


@query("m17_comparison")
def m17(spark, d):
    train, test = _split(spark, d)
    return detect.compare(train, test, FEATURES, "id")


@query("w10_rolling_detectors")
def w10(spark, d):
    return detect.rolling_origin(stash(detect.supervised(_labelled(spark, d)), "labelled"), FEATURES, "id")


@query("m17_robustness")
def m17_robustness(spark, d):
    train, test = _split(spark, d)
    return detect.robustness(detect.fit_detectors(train, FEATURES), test, "id", (0.0, 0.5), (0.25,))


@query("x29_progression")
def x29(spark, d):
    train, test = _split(spark, d)
    return detect.progression(train, test)


@query("f19_rules", "WITH n AS (SELECT l_orderkey, count(*) AS n, max(l_extendedprice) AS top, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, ((CASE WHEN n >= 10 THEN 1 ELSE 0 END) + (CASE WHEN n = 2 AND top / total > 0.9 THEN 1 ELSE 0 END) + (CASE WHEN o_totalprice / 1000 >= 100 THEN 1 ELSE 0 END)) / 5 AS rules FROM orders JOIN n ON l_orderkey = o_orderkey")
def f19(spark, d):
    rows = _labelled(spark, d).withColumn("in_txs_degree", F.lit(4.0))
    return rows.select("id", detect.rules(rows).alias("rules"))


@query("x09_bundle", "WITH " + TRUTH + CURVE + """, k AS (SELECT * FROM t ORDER BY score DESC, id LIMIT 25), a AS (SELECT sum(p * tp / (tp + fp)) / sum(p) AS ap, sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS auc FROM cu)
 SELECT (SELECT count(*) FROM t) AS n, (SELECT CAST(sum(y) AS BIGINT) FROM t) AS n_positive, round((SELECT avg(y) FROM t), 8) AS base_rate, round(ap, 8) AS pr_auc, round(auc, 8) AS roc_auc, round((SELECT sum(y) / count(*) FROM k), 8) AS precision_at_25, round((SELECT sum(y) FROM k) / (SELECT sum(y) FROM t), 8) AS recall_at_25 FROM a""")
def x09(spark, d):
    out = detect.bundle(truth(spark, d), "score", (25,), "id", "y")
    return r(out.select("n", "n_positive", "base_rate", "pr_auc", "roc_auc", "precision_at_25", "recall_at_25"), 8, "base_rate", "pr_auc", "roc_auc", "precision_at_25", "recall_at_25")


@query("x10_tx_fused", "WITH " + P.SIGNALS + """, m AS (SELECT entity, coalesce(ml, 0) AS p, coalesce(anomaly, 0) AS a FROM sig), w AS (SELECT *, 100 * (p * 0.35 + a * 0.25) / 0.6 AS raw FROM m)
 SELECT entity, round(greatest(0, least(100, CASE WHEN p >= 0.6 AND a >= 0.6 THEN least(100, raw * 1.15) WHEN a >= 0.6 AND p < 0.4 THEN least(raw, 60) ELSE raw END)), 2) AS score FROM w""")
def x10(spark, d):
    rows = P.signals(spark, d).select("entity", F.coalesce("ml", F.lit(0.0)).alias("p"), F.coalesce("anomaly", F.lit(0.0)).alias("a"))
    return detect.fused_score(rows, "score", F.col("p"), F.col("a")).select("entity", "score")


@query("x13_step_summary", "WITH " + TRUTH + """, c AS (SELECT step, count(*) AS n, avg(CASE WHEN (y = 1) = (score >= 2000) THEN 1.0 ELSE 0 END) AS a FROM t GROUP BY 1) SELECT string_agg(step || ':' || n || ':' || printf('%.6f', a), ',' ORDER BY step) AS summary FROM c""")
def x13(spark, d):
    rows = truth(spark, d).withColumn("predicted", (F.col("score") >= 2000).cast("int"))
    out = detect.step_summary(rows, "step")
    parts = F.transform(F.array_sort(F.map_entries("summary")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"]["n"].cast("string"), F.format_string("%.6f", e["value"]["accuracy"])))
    return out.select(F.array_join(parts, ",").alias("summary"))


def _entity_features(spark, d):
    """Customers as entities, some of them in planted campaigns, as (features, truth)."""
    o = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).cast("double").alias("n_events"), F.avg("o_totalprice").alias("mean_sent"), F.coalesce(F.stddev_samp("o_totalprice"), F.lit(0.0)).alias("std_sent"))
    c, k = P.table(spark, d, "customer"), F.col("c_custkey")
    bad, zero = k % 9 == 0, lambda x: F.lit(0).alias(x)
    rows = c.select(
        k.alias("entity"), "c_acctbal", F.when(bad, 3.0).otherwise(k % 4 * 1.0).alias("peak_events"), (k % 7 / 10.0).alias("burstiness"), F.when(bad & (k % 5 != 0), 0.5).otherwise(k % 10 / 25.0).alias("tor_share"), (k % 10 / 30.0).alias("network_obfuscation"),
        F.when(bad & (k % 2 == 0), 2).otherwise(0).alias("peel_chain_txs"), *map(zero, ("layering_chain_txs", "dust_spray_txs", "coinjoin_txs", "consolidation_txs", "batch_payout_txs", "max_layering_chain_len")),
        F.when(bad, k % 9).otherwise(0).alias("max_peel_chain_len"), (F.when(bad, 0.3).otherwise(0.1) + k % 11 / 50.0).alias("nbr_heuristic_exposure"),
    )
    known = c.select(k.alias("entity"), bad.alias("is_illicit"), F.when(bad, F.when(k % 2 == 0, "ransomware").otherwise("layering")).otherwise("normal").alias("scenario"), F.when(bad, F.col("c_nationkey")).otherwise(-1).alias("campaign"))
    return rows.join(o, "entity", "left").fillna(0), known


def _bench(spark, d):
    features, known = _entity_features(spark, d)
    features = stash(features, "features")
    return benchmark.Benchmark(features, known, forensics.families(features.columns), ForensicsConfig(folds=2, trees=100))


@query("m18_ablation")
def m18_ablation(spark, d):
    return _bench(spark, d).ablation()


@query("m18_baselines")
def m18_baselines(spark, d):
    return _bench(spark, d).baselines()


@query("m18_leave_one_out")
def m18_leave_one_out(spark, d):
    return _bench(spark, d).leave_one_out()


@query("m18_perturbed")
def m18_perturbed(spark, d):
    return _bench(spark, d).robustness((0.0, 0.5), (0.5,))


@query("m20_seed_enrichment", "WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS y, c_custkey % 90 = 0 AS s, c_custkey % 6 - 1 AS h FROM customer) SELECT count(*) FILTER (WHERE s) AS n_seeds, count(*) FILTER (WHERE NOT s AND h BETWEEN 1 AND 2) AS n_within_2, round(avg(y) FILTER (WHERE NOT s AND h BETWEEN 1 AND 2), 8) AS illicit_share_within_2, round(avg(y) FILTER (WHERE NOT s), 8) AS illicit_share, round(avg(CASE WHEN h BETWEEN 1 AND 2 THEN 1.0 ELSE 0 END) FILTER (WHERE NOT s AND y = 1), 8) AS illicit_found_within_2 FROM c")
def m20(spark, d):
    k = F.col("c_custkey")
    rows = P.table(spark, d, "customer").select(k.alias("entity"), (k % 9 == 0).cast("int").alias("y"), (k % 90 == 0).alias("is_seed"), (k % 6 - 1).alias("seed_hops"))
    return r(benchmark.seed_enrichment(rows), 8, "illicit_share_within_2", "illicit_share", "illicit_found_within_2")


@query("m11_watch_list")
def m11(spark, d):
    return forensics.watch_list(_entity_features(spark, d)[1])


@query("m06_importances")
def m06(spark, d):
    rows = stash(ml.vectors(P.table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label") == 0), "vectors")
    names = [f"emb_{i}" if i >= 4 else f"x{i}" for i in range(len(rows.first()["features"]))]
    return spark.createDataFrame(ml.importances(ml.forest(rows), names, "emb_"), "feature string, importance double")


@query("m08_capped_negatives", "SELECT count(*) FILTER (WHERE toxic = 1) AS positives, true AS bounded FROM labels")
def m08(spark, d):
    rows = P.table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("label"))
    got = ml.negatives_capped(rows, 50).agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("n"))
    return got.select("positives", (F.col("n") <= 100).alias("bounded"))
