"""Queries of risk synthesis, rollups, rankings, correlation, metrics and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnflow.functions import scalars as S
from cairnflow.operators import correlation, metrics, ml, risk
from cairnflow.plans import projections as P
from cairnflow.plans.q_flow import r
from cairnflow.plans.registry import query

MEAN = """(coalesce(ml * 0.35, 0) + coalesce(anomaly * 0.25, 0) + coalesce(graph * 0.2, 0) + coalesce(correlation * 0.2, 0) + coalesce(known * 0.4, 0)) /
 nullif(CASE WHEN ml IS NULL THEN 0 ELSE 0.35 END + CASE WHEN anomaly IS NULL THEN 0 ELSE 0.25 END + CASE WHEN graph IS NULL THEN 0 ELSE 0.2 END + CASE WHEN correlation IS NULL THEN 0 ELSE 0.2 END + CASE WHEN known IS NULL THEN 0 ELSE 0.4 END, 0)"""
SCORED = P.SIGNALS + f""", m AS (SELECT *, 100 * coalesce({MEAN}, 0) AS raw FROM sig),
 b AS (SELECT *, CASE WHEN coalesce(ml, 0) >= 0.6 AND (coalesce(graph, 0) >= 0.5 OR coalesce(anomaly, 0) >= 0.6 OR coalesce(known, 0) >= 0.5) THEN least(100, raw * 1.15) ELSE raw END AS up FROM m),
 sc AS (SELECT *, CAST(round(greatest(0, least(100, CASE WHEN coalesce(anomaly, 0) >= 0.6 AND coalesce(ml, 0) < 0.4 AND coalesce(graph, 0) < 0.4 AND coalesce(known, 0) < 0.4 THEN least(up, 60) ELSE up END)), 2) AS DOUBLE) AS score, correlation IS NOT NULL AS is_synthetic FROM b),
 scored AS (SELECT *, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM sc)"""
ALERTS = SCORED + """, alerts AS (SELECT *, CASE entity % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'open' WHEN 2 THEN 'dismissed' ELSE 'closed' END AS status, entity * 7919 % 10007 AS created_at, entity % 5 AS corroboration FROM scored)"""
TRUTH = "t AS (SELECT d.doc_id AS id, l.toxic AS y, CAST(d.n_chars AS DOUBLE) AS score, d.doc_id % 7 AS step FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def scored(spark, d):
    return risk.fuse(P.signals(spark, d))


def alerts(spark, d):
    k = F.col("entity")
    status = F.when(k % 4 == 0, "new").when(k % 4 == 1, "open").when(k % 4 == 2, "dismissed").otherwise("closed")
    return scored(spark, d).withColumns({"status": status, "created_at": k * 7919 % 10007, "corroboration": k % 5})


def truth(spark, d):
    rows = P.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(P.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), "y", "score", (F.col("doc_id") % 7).alias("step"))


@query("k01_fuse", "WITH " + SCORED + " SELECT entity, score, tier, is_synthetic FROM scored")
def k01(spark, d):
    return scored(spark, d).select("entity", "score", "tier", "is_synthetic")


@query("k02_boosted", "WITH " + SCORED + " SELECT entity, score FROM scored WHERE coalesce(ml, 0) >= 0.6 AND (coalesce(graph, 0) >= 0.5 OR coalesce(anomaly, 0) >= 0.6 OR coalesce(known, 0) >= 0.5)")
def k02(spark, d):
    return scored(spark, d).where(risk.corroborated()).select("entity", "score")


@query("k03_cap", "WITH " + SCORED + " SELECT entity, score FROM scored WHERE coalesce(anomaly, 0) >= 0.6 AND coalesce(ml, 0) < 0.4 AND coalesce(graph, 0) < 0.4 AND coalesce(known, 0) < 0.4")
def k03(spark, d):
    return scored(spark, d).where(risk.lone_anomaly()).select("entity", "score")


@query("k04_max_policy", "WITH " + P.SIGNALS + """ SELECT entity, round(least(100, top * CASE WHEN n >= 2 THEN 1.1 ELSE 1 END), 2) AS score FROM (SELECT entity, 100 * coalesce(greatest(ml, anomaly, graph, correlation, known), 0) AS top,
 CASE WHEN ml >= 0.5 THEN 1 ELSE 0 END + CASE WHEN anomaly >= 0.5 THEN 1 ELSE 0 END + CASE WHEN graph >= 0.5 THEN 1 ELSE 0 END + CASE WHEN correlation >= 0.5 THEN 1 ELSE 0 END + CASE WHEN known >= 0.5 THEN 1 ELSE 0 END AS n FROM sig)""")
def k04(spark, d):
    return risk.fuse(P.signals(spark, d), "max").select("entity", "score")


@query("k05_plain_policy", "WITH " + P.SIGNALS + f" SELECT entity, round(100 * coalesce({MEAN}, 0), 2) AS score FROM sig")
def k05(spark, d):
    return risk.fuse(P.signals(spark, d), "plain").select("entity", "score")


@query("k06_custom_signals", "WITH " + P.SIGNALS + f""" SELECT entity, round(100 * (coalesce(ml * 0.35, 0) + coalesce(anomaly * 0.25, 0) + coalesce(graph * 0.2, 0) + coalesce(correlation * 0.2, 0) + coalesce(known * 0.4, 0) + 0.2 * ((entity % 10) / 10.0) + 0.2) /
 (CASE WHEN ml IS NULL THEN 0 ELSE 0.35 END + CASE WHEN anomaly IS NULL THEN 0 ELSE 0.25 END + CASE WHEN graph IS NULL THEN 0 ELSE 0.2 END + CASE WHEN correlation IS NULL THEN 0 ELSE 0.2 END + CASE WHEN known IS NULL THEN 0 ELSE 0.4 END + 0.4), 2) AS score FROM sig""")
def k06(spark, d):
    custom = F.create_map(F.lit("velocity"), F.col("entity") % 10 / 10.0, F.lit("listed"), F.lit(1.7))
    return P.signals(spark, d).select("entity", risk.score_column("plain", custom=custom).alias("score"))


@query("k07_seed_boost", "WITH " + SCORED + " SELECT entity, CASE WHEN entity % 97 = 0 THEN score ELSE round(score + (100 - score) * 0.5 * ((entity % 7) / 7.3), 2) END AS score, score AS score_base FROM scored")
def k07(spark, d):
    rows = scored(spark, d).withColumns({"seed_risk": F.col("entity") % 7 / 7.3, "is_seed": F.col("entity") % 97 == 0})
    return risk.boosted(rows).select("entity", "score", "score_base")


@query("k11_status_history", "SELECT user_id AS entity, arg_max(event_type, event_id) AS status, count(*) AS n_changes FROM events GROUP BY 1")
def k11(spark, d):
    e = P.table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("entity")).agg(F.max_by("event_type", "event_id").alias("status"), F.count(F.lit(1)).alias("n_changes"))


@query("a01_rollups", "WITH " + SCORED + """ SELECT "group", max(score) AS max_score, arg_min(entity, (-score, entity)) AS max_tx, round(avg(score), 6) AS mean_score, round(sum(score * volume) / sum(volume), 6) AS weighted_score,
 round(100 * avg(CASE WHEN score >= 40 THEN 1.0 ELSE 0 END), 6) AS frequency_score, count(*) FILTER (WHERE score >= 40) AS n_flagged, bool_or(is_synthetic) AS is_synthetic,
 CASE WHEN max(score) >= 80 THEN 'CRITICAL' WHEN max(score) >= 60 THEN 'HIGH' WHEN max(score) >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM scored GROUP BY 1""")
def a01(spark, d):
    return r(risk.rollup(scored(spark, d), "group"), 6, "mean_score", "weighted_score", "frequency_score")


@query("a05_contributions", "WITH " + SCORED + """ SELECT "group", string_agg(entity || ':' || printf('%.2f', score), ',' ORDER BY score DESC, entity) AS contributions FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY score DESC, entity) AS rn FROM scored) WHERE rn <= 5 GROUP BY 1""")
def a05(spark, d):
    return risk.contributions(scored(spark, d), "group")


@query("a06_stats", "WITH " + ALERTS + " SELECT 'tier' AS kind, tier AS value, count(*) AS n FROM alerts GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM alerts GROUP BY 2 UNION ALL SELECT 'closed', 'all', count(*) FROM alerts WHERE status IN ('dismissed', 'closed')")
def a06(spark, d):
    return risk.dashboard(alerts(spark, d))


@query("a07_netfeat", "WITH " + P.TELEMETRY + ", f AS (SELECT *, epoch(ts) - min(epoch(ts)) OVER (PARTITION BY entity) AS delay FROM obs) SELECT entity, count(*) AS n_obs, round(avg(delay), 3) AS mean_delay, round(max(delay), 3) AS max_delay, count(DISTINCT ip) AS n_ips, count(DISTINCT country) AS n_countries FROM f GROUP BY 1")
def a07(spark, d):
    return r(correlation.network_features(P.telemetry(spark, d)), 3, "mean_delay", "max_delay")


@query("a08_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a08(spark, d):
    return P.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a09_top_ips", "WITH " + P.TELEMETRY + ", n AS (SELECT entity, ip, count(*) AS k FROM obs GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY k DESC, ip) AS rn FROM n) SELECT entity, ip, k, rn FROM x WHERE rn <= 5")
def a09(spark, d):
    return risk_top(P.telemetry(spark, d), ["entity"], "ip", 5)


def risk_top(rows, by, value, k):
    from pyspark.sql import Window

    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("k"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("k"), value)).cast("bigint")).where(F.col("rn") <= k)


@query("a10_top_then_time", "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12)")
def a10(spark, d):
    return P.table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12).orderBy("o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("r01_rank_alerts", "WITH " + SCORED + ", x AS (SELECT *, score > 0 AND entity % 97 <> 0 AS ok FROM scored) SELECT entity, score, tier, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY score DESC, entity) ELSE 0 END AS rank FROM x")
def r01(spark, d):
    return risk.rank_leads(scored(spark, d).withColumn("is_seed", F.col("entity") % 97 == 0)).select("entity", "score", "tier", "rank")


@query("r02_rank_entities", "WITH " + ALERTS + " SELECT entity, score, corroboration FROM alerts WHERE score >= 20 AND tier IN ('MEDIUM', 'HIGH', 'CRITICAL') ORDER BY score DESC, corroboration DESC, entity LIMIT 50")
def r02(spark, d):
    return risk.rank_entities(alerts(spark, d), 20, "MEDIUM", 50).select("entity", "score", "corroboration")


@query("r03_triage", "WITH " + ALERTS + " SELECT entity, tier, score, created_at FROM alerts ORDER BY CASE tier WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END DESC, score DESC, created_at, entity LIMIT 40")
def r03(spark, d):
    return risk.triage(alerts(spark, d), 40).select("entity", "tier", "score", "created_at")


@query("r04_page", "WITH " + ALERTS + " SELECT entity, score FROM alerts WHERE status = 'open' AND NOT is_synthetic ORDER BY CASE tier WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END DESC, score DESC, created_at, entity LIMIT 20 OFFSET 20")
def r04(spark, d):
    return risk.triage(risk.filter_alerts(alerts(spark, d), status="open", include_synthetic=False), 20, 20).select("entity", "score")


@query("p15_filter", "WITH " + ALERTS + " SELECT entity FROM alerts WHERE status = 'dismissed' AND score >= 30 AND tier IN ('MEDIUM', 'HIGH', 'CRITICAL')")
def p15(spark, d):
    return risk.filter_alerts(alerts(spark, d), "MEDIUM", "closed", True, 30).select("entity")


@query("p16_search", "WITH " + ALERTS + " SELECT entity FROM alerts WHERE entity IN (SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%0001%')")
def p16(spark, d):
    c = P.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.regexp_replace("c_name", "0001", "x0001").alias("addr"))
    o = P.table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.concat(F.lit("tx"), F.col("o_orderkey")).alias("txid"))
    return risk.search(alerts(spark, d), " X0001 ", o, c).select("entity")


@query("p19_candidates", "WITH " + P.SIGNALS + " SELECT entity FROM sig WHERE entity % 9 >= 2 AND (coalesce(ml, 0) >= 0.05 OR coalesce(graph, 0) > 0 OR coalesce(anomaly, 0) >= 0.98 OR coalesce(correlation, 0) >= 0.5 OR coalesce(known, 0) >= 0.02)")
def p19(spark, d):
    return risk.candidates(P.signals(spark, d).withColumn("n_events", F.col("entity") % 9)).select("entity")


@query("p22_reason_chips", "WITH " + P.SIGNALS + """ SELECT entity, concat_ws('|', CASE WHEN ml >= 0.6 THEN 'model' END, CASE WHEN anomaly >= 0.6 THEN 'anomaly' END, CASE WHEN graph >= 0.5 THEN 'structure' END, CASE WHEN correlation >= 0.5 THEN 'network' END, CASE WHEN known >= 0.5 THEN 'known' END,
 CASE WHEN coalesce(ml, 0) >= 0.6 AND (coalesce(graph, 0) >= 0.5 OR coalesce(anomaly, 0) >= 0.6 OR coalesce(known, 0) >= 0.5) THEN 'corroborated' END, CASE WHEN coalesce(anomaly, 0) >= 0.6 AND coalesce(ml, 0) < 0.4 AND coalesce(graph, 0) < 0.4 AND coalesce(known, 0) < 0.4 THEN 'lone anomaly' END) AS reasons FROM sig""")
def p22(spark, d):
    return P.signals(spark, d).select("entity", F.array_join(risk.reason_chips(), "|").alias("reasons"))


@query("p23_active_learning", "WITH " + SCORED + " SELECT entity, round(1 - 2 * abs(ml - 0.5), 6) AS uncertainty FROM scored WHERE score > 0 AND ml IS NOT NULL AND entity % 6 <> 0 ORDER BY 2 DESC, 1 LIMIT 25")
def p23(spark, d):
    rows = scored(spark, d)
    return risk.uncertain(rows, rows.where("entity % 6 = 0").select("entity")).select("entity", "uncertainty")


@query("r06_topk_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def r06(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return P.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("rn")).where("rn <= 3")


@query("r07_percentile", "WITH " + TRUTH + " SELECT id, round(cume_dist() OVER (ORDER BY score), 8) AS percentile FROM t")
def r07(spark, d):
    return r(metrics.percentile_rank(truth(spark, d)), 8, "percentile").select("id", "percentile")


@query("r08_prec_at_k", "WITH " + TRUTH + ", k AS (SELECT * FROM t ORDER BY score DESC, id LIMIT 50) SELECT count(*) AS k, round(sum(y) / count(*), 8) AS precision, round(sum(y) / (SELECT sum(y) FROM t), 8) AS recall, round(sum(y) / count(*) / (SELECT avg(y) FROM t), 6) AS lift FROM k")
def r08(spark, d):
    return r(r(metrics.at_k(truth(spark, d), 50, "id"), 8, "precision", "recall"), 6, "lift")


CURVE = ", c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS n FROM t GROUP BY 1), cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM c WINDOW w AS (ORDER BY score DESC))"


@query("r09_ap_auc", "WITH " + TRUTH + CURVE + " SELECT round(sum(p * tp / (tp + fp)) / sum(p), 8) AS average_precision, round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 8) AS roc_auc FROM cu")
def r09(spark, d):
    return r(metrics.ap_auc(truth(spark, d)), 8, "average_precision", "roc_auc")


@query("r10_best_f1", "WITH " + TRUTH + CURVE + ", f AS (SELECT score, tp / (tp + fp) AS precision, tp / (SELECT sum(y) FROM t) AS recall, CASE WHEN tp > 0 THEN 2 * tp / (tp + fp + (SELECT sum(y) FROM t)) ELSE 0 END AS f1 FROM cu) SELECT score, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM f ORDER BY round(f1, 12) DESC, score DESC LIMIT 1")
def r10(spark, d):
    return r(metrics.best_f1(truth(spark, d)), 8, "precision", "recall", "f1")


@query("r11_bootstrap")
def r11(spark, d):
    return metrics.bootstrap_precision(truth(spark, d).withColumn("predicted", (F.col("score") >= 2000).cast("int")))


STEP = """ SELECT {by} tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 8) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1
 FROM (SELECT {by} count(*) FILTER (WHERE y = 1 AND score >= 2000) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 2000) AS fp, count(*) FILTER (WHERE y = 1 AND score < 2000) AS fn, count(*) FILTER (WHERE y = 0 AND score < 2000) AS tn FROM t {group})"""


@query("r13_by_step", "WITH " + TRUTH + STEP.format(by="step,", group="GROUP BY 1"))
def r13(spark, d):
    return r(metrics.confusion(truth(spark, d).withColumn("predicted", (F.col("score") >= 2000).cast("int")), ["step"]), 8, "accuracy", "precision", "recall", "f1")


@query("x12_confusion", "WITH " + TRUTH + STEP.format(by="", group=""))
def x12(spark, d):
    return r(metrics.confusion(truth(spark, d).withColumn("predicted", (F.col("score") >= 2000).cast("int"))), 8, "accuracy", "precision", "recall", "f1")


@query("r12_group_recall", "WITH " + TRUTH + " SELECT step, round(avg(CASE WHEN score >= 2000 THEN 1.0 ELSE 0 END), 8) AS recall FROM t WHERE y = 1 GROUP BY 1")
def r12(spark, d):
    return truth(spark, d).where("y = 1").groupBy("step").agg(F.round(F.avg((F.col("score") >= 2000).cast("double")), 8).alias("recall"))


@query("w10_rolling_origin", "WITH " + TRUTH + " SELECT c AS cutoff, count(*) FILTER (WHERE step <= c) AS n_train, count(*) FILTER (WHERE step > c AND step <= c + 2) AS n_test, CAST(coalesce(sum(y) FILTER (WHERE step > c AND step <= c + 2), 0) AS BIGINT) AS positives FROM t, (SELECT unnest([1, 2, 3, 4]) AS c) GROUP BY 1")
def w10(spark, d):
    rows = truth(spark, d).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in (1, 2, 3, 4)])))
    late = (F.col("step") > F.col("cutoff")) & (F.col("step") <= F.col("cutoff") + 2)
    z = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("bigint")
    return rows.groupBy("cutoff").agg(z(F.col("step") <= F.col("cutoff"), "n").alias("n_train"), z(late, "n").alias("n_test"), z(late, "p").alias("positives"))


@query("r14_latest_verdict", "SELECT user_id AS entity, arg_max(event_type, event_id) AS verdict FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'view'")
def r14(spark, d):
    e = P.table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "unsure").otherwise(F.col("event_type")).alias("verdict"))
    return risk.latest_verdicts(e)


@query("r15_override", "WITH " + P.SIGNALS + " SELECT entity, CASE WHEN entity % 6 = 0 THEN 'feedback' ELSE 'seed' END AS label FROM sig WHERE entity % 4 = 0 OR entity % 6 = 0")
def r15(spark, d):
    k = P.signals(spark, d).select("entity")
    return risk.override_labels(k.where("entity % 4 = 0").withColumn("label", F.lit("seed")), k.where("entity % 6 = 0").withColumn("label", F.lit("feedback")))


@query("c01_tx_ip", """WITH o AS (SELECT event_id AS obs, user_id % 50 AS tx, event_id % 23 AS src_ip, event_id % 19 AS dst_ip, ts FROM events), f AS (SELECT tx, arg_min(src_ip, (ts, obs)) AS origin FROM o GROUP BY 1), e AS (SELECT tx, src_ip AS ip FROM o UNION ALL SELECT tx, dst_ip FROM o)
 SELECT e.tx, ip, CASE WHEN ip = origin THEN 'ORIGIN' ELSE 'RELAY' END AS role, count(*) AS n FROM e JOIN f ON e.tx = f.tx GROUP BY 1, 2, 3""")
def c01(spark, d):
    return correlation.tx_ips(hops_of(spark, d)).select("tx", "ip", "role", "n")


def hops_of(spark, d):
    i = F.col("event_id")
    return P.table(spark, d, "events").select(i.alias("obs"), (F.col("user_id") % 50).alias("tx"), (i % 23).alias("src_ip"), (i % 19).alias("dst_ip"), "ts")


@query("c04_wallet_ips", """WITH o AS (SELECT event_id AS obs, user_id % 50 AS tx, event_id % 23 AS src_ip, event_id % 19 AS dst_ip, ts FROM events), f AS (SELECT tx, arg_min(src_ip, (ts, obs)) AS origin FROM o GROUP BY 1), e AS (SELECT tx, src_ip AS ip FROM o UNION SELECT tx, dst_ip FROM o),
 l AS (SELECT e.tx, ip, CASE WHEN ip = origin THEN 'ORIGIN' ELSE 'RELAY' END AS role FROM e JOIN f ON e.tx = f.tx), i AS (SELECT DISTINCT user_id % 50 AS tx, user_id AS wallet FROM events)
 SELECT wallet, ip, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, count(DISTINCT l.tx) AS n_tx, min(l.tx) AS first_tx FROM i JOIN l ON i.tx = l.tx GROUP BY 1, 2""")
def c04(spark, d):
    w = P.table(spark, d, "events").select((F.col("user_id") % 50).alias("tx"), F.col("user_id").alias("wallet"))
    return correlation.wallet_ips(w, correlation.tx_ips(hops_of(spark, d)))


@query("c05_ip_wallets", """WITH e AS (SELECT DISTINCT user_id % 50 AS tx, event_id % 23 AS ip FROM events UNION SELECT user_id % 50, event_id % 19 FROM events), i AS (SELECT DISTINCT user_id % 50 AS tx, user_id AS wallet FROM events),
 l AS (SELECT wallet, ip, count(DISTINCT e.tx) AS n_tx FROM i JOIN e ON i.tx = e.tx GROUP BY 1, 2) SELECT ip, count(DISTINCT wallet) AS n_wallets, CAST(sum(n_tx) AS BIGINT) AS n_links FROM l GROUP BY 1""")
def c05(spark, d):
    return correlation.ip_wallets(c04(spark, d))


@query("c06_geo_fill", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(n_name, '') ELSE event_type END AS country, CASE WHEN event_id % 5 = 0 THEN coalesce(n_nationkey, 0) ELSE event_id % 5 END AS asn FROM events LEFT JOIN nation ON n_nationkey = user_id % 30")
def c06(spark, d):
    i = F.col("event_id")
    e = P.table(spark, d, "events").select("event_id", (F.col("user_id") % 30).alias("key"), F.when(i % 3 != 0, F.col("event_type")).otherwise("").alias("country"), (i % 5).alias("asn"))
    n = P.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.col("n_name").alias("country"), F.col("n_nationkey").cast("bigint").alias("asn"))
    return correlation.fill_geo(e, n, "key").select("event_id", "country", "asn")


@query("f03_wilson", "WITH n AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS k FROM events GROUP BY 1) SELECT user_id, round(greatest(0, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 8) AS low FROM n")
def f03(spark, d):
    n = P.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    return n.select("user_id", F.round(S.wilson(F.col("k"), F.col("n"))[0], 8).alias("low"))


@query("f04_time_steps", "SELECT o_orderkey, CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 14) + 1 AS INTEGER) AS step, CAST(DATE '1992-01-01' + CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 14) * 14 AS INTEGER) AS DATE) AS start FROM orders")
def f04(spark, d):
    o = P.table(spark, d, "orders").select("o_orderkey", S.step_of(F.col("o_orderdate"), "1992-01-01").alias("step"))
    return o.select("o_orderkey", "step", S.window_of_step(F.col("step"), "1992-01-01")[0].alias("start"))


@query("f06_proximity", "SELECT event_id, round(CASE WHEN epoch(ts) BETWEEN 1704672000 AND 1705276800 THEN 1.0 ELSE 0.5 ** (greatest(1704672000 - epoch(ts), epoch(ts) - 1705276800) / 86400) END, 8) AS proximity FROM events")
def f06(spark, d):
    t = F.col("ts").cast("timestamp").cast("double")
    return P.table(spark, d, "events").select("event_id", F.round(S.proximity(t, F.lit(1704672000), F.lit(1705276800)), 8).alias("proximity"))


@query("f07_propagation", "WITH " + P.TELEMETRY + """, g AS (SELECT entity, epoch(ts) AS t, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY entity ORDER BY ts, obs) AS gap FROM obs), s AS (SELECT entity, max(t) - min(t) AS span, coalesce(avg(gap) * 1000, 0) AS mean FROM g GROUP BY 1)
 SELECT entity, round(0.5 * CASE WHEN span <= 60 THEN 1 ELSE greatest(0.05, 1 / log2(span / 60 + 1)) END + 0.5 * CASE WHEN mean <= 5000 THEN 1 ELSE greatest(0.1, 1 / (1 + (mean - 5000) / 1000)) END, 8) AS consistency FROM s""")
def f07(spark, d):
    g = correlation.propagation_gaps(P.telemetry(spark, d))
    return g.select("entity", F.round(0.5 * S.burst_consistency(F.col("span_s")) + 0.5 * S.hop_consistency(F.col("mean_gap_ms")), 8).alias("consistency"))


@query("f08_topology", "WITH " + P.SIGNALS + " SELECT entity, CAST(CASE WHEN entity % 10 = 9 THEN 0.5 WHEN entity % 6 = 0 THEN 0.8 WHEN entity % 6 = 1 THEN 1 WHEN entity % 6 = 2 THEN 0.75 WHEN entity % 6 = 3 THEN 0.4 ELSE 0.15 END AS DOUBLE) AS topology FROM sig")
def f08(spark, d):
    k = F.col("entity")
    return P.signals(spark, d).select("entity", S.topology_consistency(F.when(k % 6 != 0, k % 6), k % 10 == 9).alias("topology"))


@query("f09_confidence", "WITH " + P.SIGNALS + " SELECT entity, round(greatest(0, least(1, 0.4 * coalesce(ml, 0) + 0.35 * coalesce(anomaly, 0) + 0.25 * coalesce(graph, 0))), 8) AS confidence FROM sig")
def f09(spark, d):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return P.signals(spark, d).select("entity", F.round(S.composite_confidence(z("ml"), z("anomaly"), z("graph")), 8).alias("confidence"))


@query("f10_noisy_or", "WITH " + P.SIGNALS + " SELECT entity, round(1 - (1 - coalesce(ml, 0)) * (1 - coalesce(anomaly, 0)) * (1 - coalesce(graph, 0)), 8) AS score FROM sig")
def f10(spark, d):
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return P.signals(spark, d).select("entity", F.round(S.noisy_or(z("ml"), z("anomaly"), z("graph")), 8).alias("score"))


@query("f13_tier", "WITH " + SCORED + " SELECT tier, count(*) AS n FROM scored GROUP BY 1")
def f13(spark, d):
    return scored(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("f16_severity", "WITH " + P.SIGNALS + " SELECT entity, CASE WHEN anomaly >= 0.8 THEN 'critical' WHEN anomaly >= 0.6 THEN 'high' WHEN anomaly >= 0.4 THEN 'medium' ELSE 'low' END AS severity FROM sig")
def f16(spark, d):
    return P.signals(spark, d).select("entity", S.severity(F.col("anomaly")).alias("severity"))


@query("f17_minmax", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 8) AS x FROM customer")
def f17(spark, d):
    return r(ml.min_max(P.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x")), "x"), 8, "x")


@query("f18_signed_log", "SELECT c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 8) AS x FROM customer")
def f18(spark, d):
    return P.table(spark, d, "customer").select("c_custkey", F.round(S.signed_log(F.col("c_acctbal")), 8).alias("x"))


@query("f20_digest", """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') AS digest FROM nation""")
def f20(spark, d):
    return P.table(spark, d, "nation").select("n_nationkey", S.digest(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("digest"))


@query("m07_folds", "SELECT CAST(c_custkey % 5 AS INTEGER) AS fold, count(*) AS n FROM customer GROUP BY 1")
def m07(spark, d):
    return P.table(spark, d, "customer").select(F.pmod("c_custkey", F.lit(5)).cast("int").alias("fold")).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("m14_temporal_split", "SELECT CASE WHEN user_id <= 100 THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS positives FROM events GROUP BY 1")
def m14(spark, d):
    return ml.temporal_split(P.table(spark, d, "events"), "user_id", 100).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("positives"))


@query("m01_forest")
def m01(spark, d):
    return ml.cross_fitted(ml.vectors(P.table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label") == 0), trees=300, folds=2)


@query("m03_isolation")
def m03(spark, d):
    return ml.isolation_scores(P.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")))


@query("g05_embedding")
def g05(spark, d):
    from cairnflow.plans.q_graph import trade

    return ml.ppmi_embedding(trade(spark, d))


@query("g06_peers")
def g06(spark, d):
    rows = P.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    return ml.peer_groups(rows, "entity", ["c_acctbal", "nation"], active=F.col("entity") % 7 != 0)[0]
