"""Generators, strict files, models, detectors, the simulation, and the whole analysis with labels, network evidence and feedback."""

import pytest
from pyspark.sql import functions as F

from cairnflow import durable
from cairnflow.config import ForensicsConfig, GraphConfig
from cairnflow.functions import scalars as S
from cairnflow.operators import detect, graph, ingest, metrics, ml, ordered, risk, skew
from cairnflow.plans import benchmark, forensics, report, service
from cairnflow.sources import models, raw, store, strict, synth
from cairnflow.streaming import replay

FAST = ForensicsConfig(trees=15, folds=2, embedding_dims=2, peer_groups=3, transfer_tx=0)


@pytest.fixture(scope="module")
def economy(spark):
    rows = synth.scenario_payments(spark, synth.ScenarioConfig(n_tx=700, ransomware=2, darknet=1, layering=4, dust=3))
    return durable.stash(rows, "economy")


def test_economy_spends_what_it_made(economy):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    paid = economy.where(F.size("input_amounts") > 0)
    assert paid.where(F.abs(total("input_amounts") - total("output_amounts") - F.col("fee")) > 1e-7).count() == 0 and paid.where("fee <= 0").count() == 0
    assert economy.select("txid").distinct().count() == economy.count()
    side = lambda a, v: economy.select("timestamp", F.explode(F.arrays_zip(F.col(a).alias("addr"), F.col(v).alias("amount"))).alias("x")).select("timestamp", "x.*")
    made = side("output_addresses", "output_amounts").select(F.col("timestamp").alias("made"), "addr", F.round("amount", 8).alias("amount"))
    spent = side("input_addresses", "input_amounts").withColumn("amount", F.round("amount", 8))
    assert spent.groupBy("addr", "amount").count().where("count > 1").count() == 0
    assert spent.join(made.where("amount > 0.00001"), ["addr", "amount"]).where("made < timestamp").select("addr", "amount").distinct().count() == spent.count()
    assert {r.scenario for r in economy.select("scenario").distinct().collect()} == {"normal", *synth.SCENARIOS}
    known = synth.truth(economy)
    assert known.where("illicit and campaign < 0").count() == 0 and known.where("not illicit and campaign >= 0").count() == 0
    assert known.where("illicit").select("scenario").distinct().count() == 4


def test_analysis_with_labels_network_and_feedback(spark, economy, tmp_path):
    rows = economy.drop("kind", "scenario", "campaign").withColumn("src_ip", F.concat(F.lit("10.0.0."), F.pmod(F.xxhash64("txid"), F.lit(50)))).withColumn("geo_country", F.when(F.pmod(F.xxhash64("txid"), F.lit(3)) == 0, "DE").otherwise("NL"))
    d = forensics.load(raw.as_strings(rows), unit=1.0)
    assert d.tx.count() == economy.count()
    tor = spark.createDataFrame([("10.0.0.7",), ("10.0.0.8",)], "ip string")
    p = forensics.prepare(d, f=FAST, tor=tor)
    seen = p.features.agg(F.max("tor_share"), F.max("n_origin_ips"), F.max("nbr_heuristic_exposure"), F.max("peel_chain_txs"), F.max("layering_chain_txs"), F.max("dust_spray_txs"), F.max("coinjoin_txs")).first()
    assert all(x > 0 for x in seen)
    truth = forensics.entity_truth(p, synth.truth(economy))
    y = truth.select("entity", F.col("is_illicit").cast("double").alias("label"), "campaign")
    seeds = y.where("label = 1").orderBy("entity").limit(2).select("entity")
    res = forensics.score(p, seeds, y, GraphConfig(walk_steps=8), f=FAST)
    leads = res.leads
    ranks = sorted(r["rank"] for r in leads.where("rank > 0").select("rank").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and leads.where("is_seed").count() == 2 and leads.where("is_seed and rank > 0").count() == 0
    assert leads.where("score < score_base").count() == 0 and res.labels == "labels" and leads.where("ml is not null").count() > 0
    quality = {r.signal: r.pr_auc for r in benchmark.signal_quality(leads, truth, ks=(10,)).collect()}
    assert quality["fused_score"] > 0.3
    st = store.CaseStore(spark, str(tmp_path / "store"))
    s = service.Service(res, store=st)
    n, page = s.alerts(limit=5)
    first = page.first()
    assert n == len(ranks) and first["rank"] == 1 and isinstance(first["reasons"], list)
    about = s.entity(first.entity)
    assert about["summary"].startswith(f"E-{first.entity} (") and "ranks #1 of" in about["summary"] and about["peer_group"]
    nodes, edges, events = s.neighbourhood(first.entity, 2, 12)
    assert nodes.where(F.col("hops").isNotNull()).count() <= 12 and events.count() >= edges.count() > 0
    alert = service.evidence.alerts(leads.where("rank = 1"), 0.0).first()["alert_id"]
    assert s.alert(alert)["status"] == "new" and s.patch_alert(alert, " Closed ")["status"] == "dismissed" and s.alert(alert)["status"] == "dismissed"
    with pytest.raises(KeyError):
        s.alert("nothing")
    with pytest.raises(ValueError):
        s.patch_alert(alert, "unheard")
    with pytest.raises(ValueError, match="two confirmed"):
        forensics.retrain(res, spark.createDataFrame([(first.entity, "confirmed")], "entity bigint, verdict string"), f=FAST)
    s.feedback(first.entity, "confirmed")
    watched = forensics.watch_list(truth.select("entity", "is_illicit"))
    assert {r["label"]: r["count"] for r in watched.groupBy("label").count().collect()}[1.0] >= 4
    again, counts = s.retrained(watched, FAST)
    assert counts["n_feedback"] == 1 and again.r.leads.where(F.col("entity") == first.entity).first()["is_seed"]


def test_strict_files_report_every_problem(spark, tmp_path):
    at = str(tmp_path / "strict")
    put = lambda rows, cols, name: spark.createDataFrame(rows, cols).coalesce(1).write.option("header", True).csv(f"{at}/{strict.SPECS[name].file}")
    put([(1, 1), (2, 9), (2, 3)], "txId long, class long", "txs_classes")
    put([(1, 2)], "txId1 long, other long", "txs_edgelist")
    with pytest.raises(ValueError) as e:
        strict.ingest(spark, at)
    text = str(e.value)
    assert "1 rows repeat a key" in text and "1 labels outside" in text and "expected leading columns" in text and text.count("PATH_NOT_FOUND") == 6


def test_models_and_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        models.load_latest(spark, str(tmp_path), "rf")
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "b.exe").write_text("x")
    assert [f["name"] for f in models.listing(spark, str(tmp_path))] == ["a.csv"]
    assert models.confined("/data", "a.csv") == "/data/a.csv"
    for bad in ("../a.csv", "/etc/a.csv", "x/../../a.csv", "a.exe", "file:a.csv", ""):
        with pytest.raises(ValueError):
            models.confined("/data", bad)


def test_simulation_steps(spark, tmp_path):
    tx = spark.createDataFrame([(0, 10), (1, 11), (2, 12)], "tx_idx bigint, txid bigint")
    edges = spark.createDataFrame(
        [("a", "10", "addr_tx"), ("10", "b", "tx_addr"), ("b", "11", "addr_tx"), ("10", "11", "tx_tx"), ("11", "12", "tx_tx"), ("a", "b", "addr_addr"), ("b", "c", "addr_addr"), ("12", "c", "tx_addr"), ("a", "10", "addr_tx")], "src string, dst string, relationship string"
    )
    sim = replay.Simulation(spark, str(tmp_path / "sim"), tx, edges)
    active = lambda: {(r.src, r.dst) for r in sim.active_edges().collect()}
    assert sim.status().first()["total_edges"] == 0
    assert [r.txid for r in sim.inject_next().collect()] == [10] and active() == {("a", "10"), ("10", "b"), ("a", "b")}
    assert [r.txid for r in sim.inject_batch(5).orderBy("tx_idx").collect()] == [11, 12] and len(active()) == 8
    assert sim.inject_next().count() == 0 and not sim.status().first()["can_inject_next"]
    assert sim.reset().first()["current_step"] == 1 and len(active()) == 3 and sim.reset("full").first()["total_wallets"] == 3
    with pytest.raises(ValueError):
        sim.reset("nothing")


def test_detectors_split_and_audit(spark):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 49 + 1).alias("time_step"), (F.col("id") % 3 + 1).alias("label"), (F.col("id") % 3 * 1.0).alias("fees"), F.when(F.col("id") % 5 > 0, F.col("id") % 7 * 1.0).alias("size"))
    train, test = detect.temporal_split(rows)
    assert train.agg(F.max("time_step")).first()[0] == 34 and test.agg(F.min("time_step")).first()[0] == 35 and train.where("label = 3").count() == 0
    assert all(r.passed for r in detect.audit(train, test, ["fees"]).collect())
    assert {r.check for r in detect.audit(train, train, ["fees", "label"]).where("not passed").collect()} == {"no_shared_steps", "steps_in_order", "no_forbidden_features"}
    with pytest.raises(ValueError):
        detect.temporal_split(rows, 49)
    with pytest.raises(ValueError):
        detect.train(train, ["label"])
    c = detect.train(train, ["fees", "size"], trees=5)
    assert detect.evaluate(c.score(test)).first()["accuracy"] > 0.95 and c.fill["size"] > 0
    scored = detect.infer(c, test.drop("size"), "id", "v1").collect()
    assert len(scored) == test.count() and all(0.5 <= r.probability <= 1 for r in scored)
    of = detect.spread(train, ["fees"])
    bad = detect.perturbed(test, ["fees"], of, "id", noise=1.0)
    assert bad.agg(F.avg("fees")).first()[0] == pytest.approx(test.agg(F.avg("fees")).first()[0], abs=0.4)
    assert detect.perturbed(test, ["fees"], of, "id", dropout=1.0).select("fees").distinct().count() == 1


def test_running_totals_and_hot_joins(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("n"))
    got = ordered.running(rows, [F.asc("k")], {"upto": F.col("n")}, parts=7)
    assert got.where(F.col("upto") != F.col("k") + 1).count() == 0 and got.count() == 1000
    assert ordered.running(rows.limit(0), [F.asc("k")], {"upto": F.col("n")}).count() == 0
    hot = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("key"), F.col("id").alias("row"))
    facts = hot.groupBy("key").agg(F.count("*").alias("n"), skew.salts("row"))
    out = skew.join_hot(hot, facts, "key", "row")
    assert out.count() == 500 and out.where("key = 0 and n = 400").count() == 400
    ranked = metrics.percentile_rank(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "score double")).collect()
    assert sorted((r.score, r.percentile) for r in ranked) == [(1.0, 0.25), (2.0, 0.75), (2.0, 0.75), (5.0, 1.0)]


def test_scale_free_graph(spark):
    e = graph.scale_free(spark, 2000, 4)
    assert e.where("src <= dst or dst < 0 or src >= 2000").count() == 0 and e.count() > 2000 * 4 * 0.8
    s = graph.degree_stats(e).first()
    assert s.max_degree > 12 * s.mean_degree and s.n_nodes >= 1990
    assert e.exceptAll(graph.scale_free(spark, 2000, 4)).count() == 0


def test_units_escapes_reports_and_chips(spark):
    rows = spark.createDataFrame([("1600000000000",), ("1600000000500",), ("90000000000",)], "timestamp string")
    assert ingest.epoch_unit(rows) == 1000.0 and ingest.epoch_unit(rows.limit(0)) == 1.0
    got = rows.select(S.parse_time(F.col("timestamp"), 1000.0).alias("t")).collect()
    assert sorted(r.t for r in got) == [90000000.0, 1600000000.0, 1600000000.5]
    one = spark.createDataFrame([("<a href='x'>\u0001&\"",)], "t string").select(S.escape_markup(F.col("t")).alias("t")).first()["t"]
    assert one == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    text = report.markdown("Title", {"a": [{"x": 0.12345, "y": None}], "b": []})
    assert "| 0.123 | n/a |" in text and "No rows." in text
    tx = spark.createDataFrame([(1, True), (2, False), (3, True)], "tx bigint, illicit boolean")
    scores = spark.createDataFrame([(3, 55.0, "MEDIUM", True)], "tx bigint, score double, tier string, is_synthetic boolean")
    assert sorted(tuple(r) for r in risk.default_scores(tx, scores).collect()) == [(1, 80.0, "HIGH", False), (2, 10.0, "LOW", False), (3, 55.0, "MEDIUM", True)]


def test_peers_of_too_few(spark):
    rows = spark.range(10).select(F.col("id").alias("entity"), F.col("id").cast("double").alias("x"))
    groups, described = ml.peer_groups(rows, "entity", ["x"], k=3)
    assert {r.peer_group for r in groups.collect()} == {-1} and described.count() == 0
    rows = spark.range(60).select(F.col("id").alias("entity"), (F.col("id") % 3 * 10.0).alias("x"), F.col("id").alias("n"))
    groups, described = ml.peer_groups(rows, "entity", ["x"], k=3, active=F.col("n") < 50)
    assert groups.where("peer_group = -1").count() == 10 and described.agg(F.sum("size")).first()[0] == 50


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable.shared_dir(Session())
