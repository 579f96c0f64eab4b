"""Sources, round trips, the whole analysis on synthetic payments, the store, streaming, and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cairnflow.config import ForensicsConfig
from cairnflow.plans import catalogue, forensics, service
from cairnflow.sources import raw, store, synth
from cairnflow.streaming import replay

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def payments(spark):
    return synth.payments(spark, synth.SynthConfig(n_tx=400, n_users=120, pools_per_1000=40, dust_per_1000=30))


def test_synthetic_payments_conserve_value(payments):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    assert payments.where(F.abs(total("input_amounts") - total("output_amounts") - F.col("fee")) > 1e-9).count() == 0
    assert payments.select("txid").distinct().count() == 400


@pytest.mark.parametrize("kind", ["csv", "json", "xml"])
def test_round_trip(spark, payments, tmp_path, kind):
    path = str(tmp_path / f"out.{kind}")
    rows = payments.drop("kind").withColumn("timestamp", F.col("timestamp").cast("string"))
    getattr(raw, f"write_{kind}")(rows, path)
    if kind == "json":
        back = raw._strings(spark.read.json(path))
    else:
        back = raw.read_raw(spark, path)
    d = forensics.load(back, unit=1.0)
    assert d.tx.count() == 400 and {r.reason: r.n for r in d.dropped.collect()} == {"kept": 400}
    assert d.outputs.count() == payments.select(F.explode("output_amounts")).count()


def test_unsupported_file(spark):
    with pytest.raises(ValueError, match="unsupported"):
        raw.read_raw(spark, "/tmp/x.docx")


def test_analysis_and_service(spark, payments):
    d = forensics.load(raw._strings(payments.drop("kind")), unit=1.0)
    seeds = d.outputs.select("addr").limit(1)
    result = forensics.analyse(d, seeds, f=ForensicsConfig(transfer_tx=0, embedding_dims=2, peer_groups=3))
    leads = result.leads.cache()
    ranks = [r["rank"] for r in leads.where("rank > 0").orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and leads.where("is_seed and rank > 0").count() == 0
    assert leads.count() == result.features.count() == result.members.select("entity").distinct().count()
    s = service.Service(result)
    n, page = s.alerts(limit=5)
    first = page.first()
    assert n == len(ranks) and first["rank"] == 1
    package = s.report([first.entity])
    assert service.verify(package)
    package["body"]["entities"][0]["n_addresses"] += 1
    assert not service.verify(package)
    with pytest.raises(KeyError):
        s.entity(-5)
    with pytest.raises(ValueError):
        s.alerts(limit=0)
    nodes, edges = s.subgraph(first.entity, 1, 10)
    assert nodes.count() <= 10 and edges.count() >= 0


def test_case_store(spark, tmp_path):
    st = store.CaseStore(spark, str(tmp_path / "store"))
    assert st.feedback().count() == 0
    for e, v in ((1, "confirmed"), (2, "confirmed"), (2, "unsure"), (1, "dismissed")):
        st.give("d", e, v)
    assert [(r.entity, r.verdict) for r in st.verdicts("d").collect()] == [(1, "dismissed")]
    st.put_case("c1", "First", [1])
    st.put_case("c1", "First", [1, 2], "closed")
    assert [(r.case_id, r.status, r.entities) for r in st.cases().collect()] == [("c1", "closed", [1, 2])]
    with pytest.raises(ValueError):
        st.give("d", 1, "maybe")


def test_synthetic_export_refuses_real_rows(spark, payments, tmp_path):
    obs = synth.observations(payments.limit(5))
    raw.write_synthetic(obs, str(tmp_path / "obs"))
    with pytest.raises(ValueError):
        raw.write_synthetic(obs.withColumn("is_synthetic", F.lit(False)), str(tmp_path / "no"))


def test_stream_matches_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = replay.source(spark, f"{sf}/*events.parquet", events.schema)
    out = replay.drain(replay.hourly(stream), str(tmp_path / "out"), str(tmp_path / "c"), "complete")
    assert out.agg(F.sum("n")).first()[0] == events.count()


def rows_of(columns, rows):
    """Rows as sorted tuples, floats to nine digits."""
    fix = lambda v: float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v
    return sorted((tuple(fix(r[c]) for c in columns) for r in rows), key=str)


QUICK = ["n01_first_obs", "p07_drop_reasons", "h02_equal_outputs", "h04_change", "e09_recv", "e19_burstiness", "g10_edges", "g22_clustering", "k01_fuse", "a01_rollups", "r01_rank_alerts", "r09_ap_auc", "c01_tx_ip", "f06_proximity", "j10_ip_range"]


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    rel = con.sql(catalogue.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert rows_of(columns, [r.asDict() for r in df.collect()]) == rows_of(columns, [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("kind", ["s01_csv", "s02_json_lines", "s04_xml"])
def test_registered_round_trips_hold_every_transaction(spark, sf, kind):
    from cairnflow.plans import projections as P

    want = {(r.tx_idx, ",".join(map(str, r.a)), r.n) for r in P.payments(spark, sf).outputs.groupBy("tx_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "addr"))), lambda x: x["addr"]).alias("a"), F.count(F.lit(1)).alias("n")).collect()}
    got = [tuple(r) for r in catalogue.QUERIES[f"{kind}_round_trip_whole"](spark, sf).collect()]
    assert len(want) > 300 and len(got) == len(want) and set(got) == want
    assert catalogue.QUERIES[f"{kind}_round_trip"](spark, sf).count() == 300


def test_whole_trade_queries_use_every_line(spark, sf):
    assert catalogue.QUERIES["g10_edges_whole"](spark, sf).agg(F.sum("n_tx")).first()[0] == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    for name in ("g02_walk", "g12_trail", "g20_pagerank", "g22_clustering", "g26_simple_paths", "g30_common"):
        assert "% 3" not in catalogue.ORACLE[f"{name}_whole"] and "% 4" not in catalogue.ORACLE[f"{name}_whole"] and "src < 20" not in catalogue.ORACLE[f"{name}_whole"]
        assert "l_quantity >=" not in catalogue.ORACLE[f"{name}_whole"]
    assert {r.node for r in catalogue.QUERIES["g20_pagerank_whole"](spark, sf).collect()} == set(range(25))
