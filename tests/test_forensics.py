"""Hand-built cases of the heuristics, chains, entities, graph and risk operators."""

import pytest
from pyspark.sql import functions as F

from cairnflow.config import HeuristicConfig
from cairnflow.functions import scalars as S
from cairnflow.operators import chains, components, correlation, entities, graph, heuristics, ingest, risk

T0 = 1_740_787_200
C = HeuristicConfig()


def book(spark, txs):
    """(tx, inputs, outputs) from (ts, [(addr, amount)], [(addr, amount)])."""
    tx = [(i, f"t{i}", ts, len(a), len(b)) for i, (ts, a, b) in enumerate(txs)]
    side = lambda k: [(i, addr, float(v), p) for i, t in enumerate(txs) for p, (addr, v) in enumerate(t[k])]
    schema = "tx_idx bigint, addr string, amount double, pos int"
    return spark.createDataFrame(tx, "tx_idx bigint, txid string, ts bigint, n_in bigint, n_out bigint"), spark.createDataFrame(side(1), schema), spark.createDataFrame(side(2), schema)


def test_pool_needs_equal_outputs_of_many_payers(spark):
    tx, i, o = book(spark, [(T0, [(f"a{k}", 0.2) for k in range(5)], [(f"b{k}", 0.1) for k in range(5)] + [(f"c{k}", 0.0999) for k in range(5)]), (T0 + 9, [("x", 1.0)], [("y", 0.25), ("z", 0.7499)])])
    rows = {r.tx_idx: r for r in heuristics.pools(tx, i, o, C).collect()}
    assert rows[0].is_pool and rows[0].equal == 5 and not rows[1].is_pool


def test_dust_spray(spark):
    tx, i, o = book(spark, [(T0, [("a", 0.01)], [(f"d{k}", 5.46e-6) for k in range(20)] + [("a2", 0.0098)])])
    assert heuristics.dust(tx, o, C).first()[1:] == (20, True)


def test_change_address(spark):
    tx, i, o = book(spark, [(T0, [("z", 1.0)], [("dest", 1.0)]), (T0 + 60, [("a", 1.0)], [("dest", 0.1), ("chg", 0.8999)])])
    pool = heuristics.pools(tx, i, o, C)
    r = heuristics.change(tx, o, heuristics.lifecycle(tx, i, o), pool, C).first()
    assert r.change_addr == "chg" and r.confidence >= 0.5 and r.round_payment


def peel(step):
    txs, left = [(T0 - 9, [("m", 9.0)], [(f"d{k}", 1.0) for k in range(8)])], 10.0
    for k in range(8):
        txs.append((T0 + k * step, [(f"p{k}", left)], [(f"d{k}", 0.1), (f"p{k + 1}", left - 0.10013)]))
        left -= 0.10013
    return txs


@pytest.mark.parametrize(("step", "n"), [(1800, 8), (3 * 86400, 0)])
def test_peel_chain_needs_haste(spark, step, n):
    tx, i, o = book(spark, peel(step))
    pool, life = heuristics.pools(tx, i, o, C), heuristics.lifecycle(tx, i, o)
    found = chains.follow(heuristics.peel_links(tx, life, pool, heuristics.change(tx, o, life, pool, C), C), C.peel_min_length).collect()
    assert len(found) == n and all(r.length == 8 for r in found) and sorted(r.pos for r in found) == list(range(n))


def test_layering(spark):
    tx, i, o = book(spark, [(T0 + 300 * k, [(f"l{k}", 1.0)], [(f"l{k + 1}", 0.999)]) for k in range(6)])
    pool, life = heuristics.pools(tx, i, o, C), heuristics.lifecycle(tx, i, o)
    hops = heuristics.rapid_hops(tx, i, life, pool, C)
    assert sorted(r.tx_idx for r in hops.collect()) == [1, 2, 3, 4, 5]
    found = chains.follow(heuristics.layer_links(hops, tx, o, life), 3).collect()
    assert {r.length for r in found} == {5}


def test_fans(spark):
    tx, i, o = book(spark, [(T0, [(f"a{k}", 1.0) for k in range(12)], [("b", 12.0)]), (T0 + 60, [("b", 12.0)], [(f"c{k}", 0.5 + k / 10) for k in range(13)])])
    rows = heuristics.fans(tx, heuristics.pools(tx, i, o, C), heuristics.dust(tx, o, C), C).orderBy("tx_idx").collect()
    assert [(r.consolidation, r.batch_payout) for r in rows] == [(True, False), (False, True)]


def test_converging_chains_belong_to_the_latest_start(spark):
    links = spark.createDataFrame([(0, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (8, 9)], "tx_idx bigint, next bigint")
    rows = {r.tx_idx: (r.start, r.pos, r.length) for r in chains.follow(links, 3).collect()}
    assert rows == {0: (0, 0, 5), 2: (0, 1, 5), 1: (1, 0, 5), 3: (1, 1, 5), 4: (1, 2, 5), 5: (1, 3, 5), 6: (1, 4, 5)}


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 9), (1, 2), (2, 3), (3, 1), (7, 7), (None, 1)], "src bigint, dst bigint")
    assert {r.node: r.component for r in components.connected_components(e).collect()} == {4: 4, 5: 4, 9: 4, 1: 1, 2: 1, 3: 1, 7: 7}
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "src bigint, dst bigint")
    assert {r.component for r in components.connected_components(path).collect()} == {0}
    assert components.connected_components(e.limit(0)).count() == 0


def test_common_inputs_share_an_entity(spark):
    tx, i, o = book(spark, [(T0, [("a", 0.5), ("b", 0.5)], [("z", 0.999)])])
    pool = heuristics.pools(tx, i, o, C)
    none = spark.createDataFrame([], "tx_idx bigint, change_addr string, confidence double")
    assert [(r.src, r.dst) for r in entities.ownership_edges(tx, i, pool, none).orderBy("src").collect()] == [("a", "a"), ("b", "a")]


def test_dwell_and_pass_through(spark):
    tx, i, o = book(spark, [(T0, [("src", 1.0)], [("mule", 0.9999)]), (T0 + 60, [("mule", 0.9999)], [("out", 0.9998)])])
    member = spark.createDataFrame([("src", 1), ("mule", 2), ("out", 3)], "addr string, entity bigint")
    d = {r.entity: r for r in entities.dwell(i, tx, heuristics.lifecycle(tx, i, o), member).collect()}
    assert d[2].median_dwell_s == 60.0 and d[2].rapid_spend_share == 1.0 and d[1].median_dwell_s == -1.0
    sent = entities.sent(i, member)
    recv = entities.received(entities.external_outputs(o, member, sent))
    p = {r.entity: r for r in entities.pass_through(member.select("entity"), entities.sent_stats(sent, tx), entities.recv_stats(recv)).collect()}
    assert p[2].pass_through_ratio > 0.99


def sym(spark, pairs):
    return spark.createDataFrame([x for a, b in pairs for x in ((a, b, 1.0), (b, a, 1.0))], "src bigint, dst bigint, w double")


def test_hops_and_walk(spark):
    e = sym(spark, [(0, 1), (1, 2), (2, 3), (3, 4)])
    seed = spark.createDataFrame([(0,)], "node bigint")
    assert {r.node: r.hops for r in graph.hops(e, seed).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    two = spark.createDataFrame([(0,), (4,)], "node bigint")
    assert {r.node: (r.hops, r.nearest) for r in graph.hops(e, two).collect()} == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (1, 4), 4: (0, 4)}
    hub = spark.createDataFrame([(1,)], "node bigint")
    assert {r.node for r in graph.hops(e, seed, absorbing=hub).collect()} == {0, 1}
    rank = {r.node: r["rank"] for r in graph.random_walk(graph.normalised(e), seed, steps=10).collect()}
    assert rank[1] > rank[2] > rank[3] > rank[4] > 0


def test_graph_measures(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src bigint, dst bigint")
    assert {r.node: round(r.coefficient, 3) for r in graph.clustering(e).collect()} == {1: 1.0, 2: 1.0, 3: 0.333, 4: 0.0}
    assert sum(r["rank"] for r in graph.pagerank(e).collect()) == pytest.approx(1.0)
    h = {r.node: r for r in graph.hits(e, 30).collect()}
    assert sum(r.hub for r in h.values()) == pytest.approx(1.0) and h[3].hub == max(r.hub for r in h.values())
    assert graph.shortest_path(e, 1, 4) == [1, 2, 3, 4] and graph.shortest_path(e, 4, 1) is None
    assert sorted(r.path for r in graph.simple_paths(e, 1, 4).collect()) == [[1, 2, 3, 4]]


def test_drop_reasons_first_wins(spark):
    good = ("2025-03-01T00:00:00Z", "t1", '["a"]', "b|c", "[1.5]", "0.5;1")
    rows = [good, ("junk", "", "[", "b", "x", "1"), ("1740787200", " ", "a", "b", "1", "1"), ("1740787200000", "t", "a", "b", "1", "[1, x"), ("2025-03-01", "t", "a,b", "c", "1", "1"), ("2025-03-01", "t", "a", "", "1", ""), ("2025-03-01", "t", "a", "b", "1", "-1")]
    df = spark.createDataFrame(rows, "Time string, tx_hash string, input_addresses string, outputs string, input_amounts string, output_amounts string")
    out, renames = ingest.canonical(df)
    assert renames == {"Time": "timestamp", "tx_hash": "txid", "outputs": "output_addresses"}
    assert {r.reason: r.n for r in ingest.drop_reasons(ingest.parse_rows(out)).collect()} == {k: 1 for k in ("kept", "unparseable_timestamp", "missing_txid", "malformed_list_cell", "address_amount_length_mismatch", "no_outputs", "negative_amount")}
    with pytest.raises(ValueError, match="missing columns"):
        ingest.canonical(df.drop("tx_hash"))


def test_scalars(spark):
    ips = spark.createDataFrame([("1.0.0.0",), ("255.255.255.255",), ("bad",), ("1.2.3",), ("::1",), ("",), (None,), ("1.2.3.256",)], "ip string")
    assert [r[0] for r in ips.select(S.ip_to_int(F.col("ip"))).collect()] == [16777216, 4294967295, -1, -1, -1, -1, -1, -1]
    boost = spark.createDataFrame([(0.0, 1.0), (30.0, 0.0), (90.0, 0.5), (100.0, 1.0)], "s double, r double")
    assert [r[0] for r in boost.select(S.seed_boost(F.col("s"), F.col("r"), 0.5)).collect()] == [50.0, 30.0, 92.5, 100.0]
    cells = spark.createDataFrame([('["a","b"]',), ("a|b|c",), ("a;b",), ("a, b",), ("",), (None,), ("solo",)], "c string")
    assert [r[0] for r in cells.select(S.parse_list(F.col("c"))).collect()] == [["a", "b"], ["a", "b", "c"], ["a", "b"], ["a", "b"], [], [], ["solo"]]


@pytest.mark.parametrize(
    ("s", "policy", "score", "tier"),
    [
        ((0.9, None, 0.6, None, None), "weighted", 90.95, "CRITICAL"), ((None, 0.9, None, None, None), "weighted", 60.0, "HIGH"), ((None,) * 5, "weighted", 0.0, "LOW"),
        ((0.5, None, None, None, None), "weighted", 50.0, "MEDIUM"), ((0.9, 0.8, None, None, None), "max", 99.0, "CRITICAL"), ((0.9, None, 0.6, None, None), "plain", 79.09, "HIGH"),
    ],
)
def test_risk_scores(spark, s, policy, score, tier):
    row = spark.createDataFrame([(1, *s)], "entity bigint, ml double, anomaly double, graph double, correlation double, known double")
    r = risk.fuse(row, policy).first()
    assert r.score == pytest.approx(score, abs=0.01) and r.tier == tier


def test_ranks_skip_seeds(spark):
    rows = spark.createDataFrame([(1, 50.0, False), (2, 70.0, True), (3, 50.0, False), (4, 0.0, False), (5, 60.0, False)], "entity bigint, score double, is_seed boolean")
    assert {r.entity: r["rank"] for r in risk.rank_leads(rows).collect()} == {5: 1, 1: 2, 3: 3, 2: 0, 4: 0}


def test_range_join(spark):
    pts = spark.createDataFrame([(134744072,), (50529027,)], "n bigint")
    rng = spark.createDataFrame([(134744064, 134744319, "ZZ")], "start bigint, end bigint, country string")
    assert [(r.n, r.country) for r in correlation.range_join(pts, rng, "n").where("country is not null").collect()] == [(134744072, "ZZ")]
