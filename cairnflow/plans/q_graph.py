"""Queries of the graph and join operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnflow.durable import stash
from cairnflow.functions import scalars as S
from cairnflow.operators import correlation, graph, heuristics, ingest
from cairnflow.plans import projections as P
from cairnflow.plans.q_flow import LIFE, MEMBER, Book, W, r
from cairnflow.plans.registry import ORACLE, query

#: Nation-to-nation trade: customers' nations pay suppliers' nations; a small graph with a wide range of weights.
TRADE = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_extendedprice AS amount, CAST(epoch(o_orderdate) AS BIGINT) AS ts, l_orderkey * 10 + l_linenumber AS tx_idx
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45)"""
ADJ = """, pr AS (SELECT src, dst, 1 + ln(1 + sum(amount)) AS w FROM {flow} WHERE src <> dst GROUP BY 1, 2),
 t1 AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rn FROM pr) WHERE rn <= {a}),
 sy AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM t1 UNION ALL SELECT dst, src, w FROM t1) GROUP BY 1, 2),
 adj AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS rn FROM sy) WHERE rn <= {b}),
 walk AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM adj)"""


def trade(spark, d, whole=False):
    lines = P.table(spark, d, "lineitem")
    lines = (lines if whole else lines.where("l_quantity >= 45")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    orders = P.table(spark, d, "orders").select("o_orderkey", "o_custkey", P.seconds("o_orderdate").alias("ts"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(P.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(P.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"), F.col("l_extendedprice").alias("amount"), "ts", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tx_idx"))


@query("g01_adjacency", W + MEMBER + ADJ.format(flow="flow", a=50, b=100) + " SELECT src, dst, round(w, 6) AS w FROM adj")
def g01(spark, d):
    return r(graph.adjacency(Book(spark, d).written().flow), 6, "w")


@query("g02_walk", "WITH " + TRADE + ADJ.format(flow="trade", a=50, b=100) + " SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(p, 8) AS p FROM walk")
def g02(spark, d):
    return r(graph.normalised(graph.adjacency(trade(spark, d))), 8, "p")


@query("g03_propagation", W + MEMBER + ADJ.format(flow="flow", a=50, b=100) + """, v AS (SELECT entity AS node, CASE WHEN entity % 7 = 0 THEN 1.0 ELSE 0 END AS x FROM (SELECT DISTINCT entity FROM member)),
 one AS (SELECT src AS node, sum(p * x) AS x FROM walk JOIN v ON node = dst GROUP BY 1), two AS (SELECT src AS node, sum(p * x) AS x FROM walk JOIN one ON node = dst GROUP BY 1)
 SELECT one.node, round(one.x, 8) AS one_hop, round(two.x, 8) AS two_hop FROM one JOIN two ON one.node = two.node""")
def g03(spark, d):
    b = Book(spark, d).written()
    walk = stash(graph.normalised(graph.adjacency(b.flow)), "walk")
    v = b.member.select(F.col("entity").alias("node")).distinct().withColumn("x", (F.col("node") % 7 == 0).cast("double"))
    one = graph.propagate(walk, v, ["x"])
    two = graph.propagate(walk, one, ["x"])
    return r(one.withColumnRenamed("x", "one_hop").join(two.withColumnRenamed("x", "two_hop"), "node"), 8, "one_hop", "two_hop")


def _ppr_sql(steps: int) -> str:
    s, prev = "", "SELECT node, 0.5 AS rank FROM seed"
    for i in range(steps):
        s += f", r{i} AS ({prev})"
        prev = f"SELECT coalesce(m.node, s.node) AS node, 0.85 * coalesce(got, 0) + CASE WHEN s.node IS NULL THEN 0 ELSE 0.15 * 0.5 END AS rank FROM (SELECT dst AS node, sum(p * rank) AS got FROM walk JOIN r{i} ON node = src GROUP BY 1) m FULL JOIN seed s ON s.node = m.node"
    return s + f", final AS ({prev})"


@query("g07_ppr", "WITH " + TRADE + ADJ.format(flow="trade", a=5, b=8) + ", seed AS (SELECT n_nationkey AS node FROM nation WHERE n_nationkey IN (3, 17))" + _ppr_sql(12) + " SELECT CAST(node AS BIGINT) AS node, round(rank, 9) AS rank FROM final")
def g07(spark, d):
    from cairnflow.config import GraphConfig

    walk = graph.normalised(graph.adjacency(trade(spark, d), GraphConfig(per_source=5, per_node=8)))
    seeds = spark.createDataFrame([(3,), (17,)], "node bigint")
    return r(graph.random_walk(walk, seeds, steps=12), 9, "rank")


HOPS = """, adjo AS (SELECT src, dst FROM own UNION SELECT dst, src FROM own), seed AS (SELECT DISTINCT src AS node FROM own WHERE src % 22 = 0),
 bfs AS (SELECT node, 0 AS hops, node AS nearest FROM seed UNION SELECT dst, hops + 1, nearest FROM bfs JOIN adjo ON src = node WHERE hops < 4),
 dist AS (SELECT node, min(hops) AS hops FROM bfs GROUP BY 1), hop AS (SELECT d.node, d.hops, min(nearest) AS nearest FROM dist d JOIN bfs b ON b.node = d.node AND b.hops = d.hops GROUP BY 1, 2)"""


def _links(spark, d):
    own = P.ownership(spark, d)
    return own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("g08_hops", "WITH RECURSIVE " + P.OWNERSHIP + HOPS + " SELECT * FROM hop")
def g08(spark, d):
    e = _links(spark, d)
    return graph.hops(e, e.where("src % 22 = 0 and src % 2 = 0").select(F.col("src").alias("node")).distinct())


@query("g09_gated_risk", "WITH RECURSIVE " + P.OWNERSHIP + HOPS + " SELECT node, CASE WHEN hops = 0 THEN 1.0 WHEN node % 5 = 0 THEN 0.0 ELSE round(0.5 ** hops, 6) END AS risk FROM hop")
def g09(spark, d):
    return g08(spark, d).select("node", F.when(F.col("hops") == 0, 1.0).when(F.col("node") % 5 == 0, 0.0).otherwise(F.round(F.pow(F.lit(0.5), "hops"), 6)).alias("risk"))


@query("g10_edges", "WITH " + TRADE + " SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, round(sum(amount), 2) AS amount, count(*) AS n_tx, min(ts) AS first_ts, max(ts) AS last_ts FROM trade GROUP BY 1, 2")
def g10(spark, d):
    return r(graph.aggregated_edges(trade(spark, d)), 2, "amount")


@query("g12_trail", "WITH RECURSIVE " + TRADE + """, trail AS (SELECT 0 AS step, CAST(5 AS BIGINT) AS here, CAST(NULL AS BIGINT) AS src, CAST(NULL AS DOUBLE) AS amount, CAST(-1 AS BIGINT) AS ts, [CAST(5 AS BIGINT)] AS seen
 UNION ALL SELECT * FROM (SELECT step + 1, CAST(dst AS BIGINT), CAST(t.src AS BIGINT), t.amount, t.ts, list_append(seen, CAST(dst AS BIGINT)) FROM trail JOIN trade t ON t.src = trail.here AND t.ts > trail.ts AND NOT list_contains(seen, t.dst)
 WHERE step < 15 ORDER BY t.amount DESC, t.ts, t.tx_idx, t.dst LIMIT 1)) SELECT CAST(step - 1 AS INTEGER) AS step, src, here AS dst, amount, ts FROM trail WHERE step > 0""")
def g12(spark, d):
    return graph.money_trail(trade(spark, d), 5)


EDGES = """edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'lives_in' AS relationship FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'based_in' FROM supplier
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'ordered' FROM orders)"""


def typed_edges(spark, d):
    """Four kinds of edges, with node ids that start with the node's kind."""
    tag = lambda t, c: F.concat(F.lit(t), F.col(c))
    parts = [("customer", "c", "c_custkey", "n", "c_nationkey", "lives_in"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "based_in"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "part_of"), ("orders", "c", "o_custkey", "o", "o_orderkey", "ordered")]
    out = None
    for t, a, s, b, dst, rel in parts:
        e = ingest.edges_of(P.table(spark, d, t).select(tag(a, s).alias("s"), tag(b, dst).alias("t")), "s", "t", rel)
        out = e if out is None else out.unionByName(e)
    return out


@query("g14_multigraph", "WITH " + EDGES + " SELECT relationship, count(*) AS n, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM edges GROUP BY 1")
def g14(spark, d):
    return typed_edges(spark, d).groupBy("relationship").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("n_src"), F.count_distinct("dst").alias("n_dst"))


@query("g15_nodes_by_type", "WITH " + EDGES + " SELECT kind, count(*) AS n FROM (SELECT DISTINCT id, id[1] AS kind FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)) GROUP BY 1")
def g15(spark, d):
    e = typed_edges(spark, d)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return nodes.groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("g16_incident", "WITH " + EDGES + " SELECT src, dst, relationship FROM edges WHERE src = 'n3' UNION ALL SELECT src, dst, relationship FROM edges WHERE dst = 'n3'")
def g16(spark, d):
    return graph.incident(typed_edges(spark, d), "n3").select("src", "dst", "relationship")


@query("g17_neighbors", "WITH " + EDGES + " SELECT dst AS node FROM edges WHERE src = 'c7' AND relationship = 'ordered' UNION SELECT src FROM edges WHERE dst = 'c7' AND relationship = 'ordered'")
def g17(spark, d):
    return graph.neighbours(typed_edges(spark, d), "c7", relationship="ordered")


@query("g19_degree_by_rel", "WITH " + EDGES + """, ends AS (SELECT src AS node, relationship, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, relationship, 0, 1 FROM edges)
 SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(coalesce(sum(o + i) FILTER (WHERE relationship = 'ordered'), 0) AS BIGINT) AS ordered FROM ends GROUP BY 1""")
def g19(spark, d):
    return graph.degree_features(typed_edges(spark, d)).select("node", "in_degree", "out_degree", F.coalesce(F.element_at("by_relationship", F.lit("ordered")), F.lit(0)).alias("ordered"))


def _pagerank_sql(steps: int) -> str:
    s, prev = "", "SELECT node, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes"
    for i in range(steps):
        s += f", k{i} AS ({prev})"
        prev = f"SELECT n.node, 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM k{i} WHERE node NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM nodes)) + 0.15 / (SELECT count(*) FROM nodes) AS rank FROM nodes n LEFT JOIN (SELECT dst AS node, sum(p * rank) AS got FROM w JOIN k{i} ON node = src GROUP BY 1) m ON m.node = n.node"
    return s + f", final AS ({prev})"


@query("g20_pagerank", "WITH " + TRADE + ", e AS (SELECT src, dst FROM trade WHERE src < 20), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS p FROM e GROUP BY 1, 2)" + _pagerank_sql(8) + " SELECT CAST(node AS BIGINT) AS node, round(rank, 9) AS rank FROM final")
def g20(spark, d):
    return r(graph.pagerank(trade(spark, d).where("src < 20"), steps=8, tolerance=0.0), 9, "rank")


@query("g22_clustering", "WITH " + TRADE + """, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM trade WHERE src <> dst AND (src + dst) % 3 <> 0), bi AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 dg AS (SELECT a AS node, count(*) AS d FROM bi GROUP BY 1), tr AS (SELECT x.a AS node, count(*) AS t FROM bi x JOIN bi y ON x.a = y.a AND x.b < y.b JOIN e ON e.a = x.b AND e.b = y.b GROUP BY 1)
 SELECT CAST(dg.node AS BIGINT) AS node, round(CASE WHEN d >= 2 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 8) AS coefficient FROM dg LEFT JOIN tr ON tr.node = dg.node""")
def g22(spark, d):
    return r(graph.clustering(trade(spark, d).where("(src + dst) % 3 <> 0")), 8, "coefficient")


@query("g23_hits")
def g23(spark, d):
    return r(graph.hits(trade(spark, d), steps=10), 9, "hub", "authority")


@query("g25_shortest", "WITH RECURSIVE " + P.OWNERSHIP + """, adjo AS (SELECT src, dst FROM own UNION SELECT dst, src FROM own), start AS (SELECT min(src) AS s FROM own),
 bfs AS (SELECT s AS node, 0 AS d FROM start UNION SELECT dst, d + 1 FROM bfs JOIN adjo ON src = node WHERE d < 8) SELECT max(m) AS length FROM (SELECT node, min(d) AS m FROM bfs GROUP BY 1)""")
def g25(spark, d):
    e = _links(spark, d)
    s = e.where("src % 2 = 0").agg(F.min("src")).first()[0]
    far = graph.hops(e, spark.createDataFrame([(s,)], "node bigint"), 8).orderBy(F.desc("hops"), "node").first()
    path = graph.shortest_path(e, s, far["node"])
    return spark.createDataFrame([(len(path) - 1,)], "length int")


@query("g26_simple_paths", "WITH RECURSIVE " + TRADE + """, e AS (SELECT DISTINCT src, dst FROM trade WHERE (src * 3 + dst) % 4 = 0 AND src <> dst),
 w AS (SELECT 0 AS node, [0] AS path UNION ALL SELECT dst, list_append(path, dst) FROM w JOIN e ON src = node WHERE node <> 8 AND NOT list_contains(path, dst) AND len(path) <= 4)
 SELECT array_to_string(path, '-') AS path FROM w WHERE node = 8""")
def g26(spark, d):
    e = stash(trade(spark, d).where("(src * 3 + dst) % 4 = 0 and src <> dst").select("src", "dst").distinct(), "sparse")
    return graph.simple_paths(e, 0, 8, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


EGO = """, adjo AS (SELECT src, dst FROM own UNION SELECT dst, src FROM own), hub AS (SELECT src AS h FROM adjo GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1),
 bfs AS (SELECT h AS node, 0 AS d FROM hub UNION SELECT dst, d + 1 FROM bfs JOIN adjo ON src = node WHERE d < 3), ego AS (SELECT node, min(d) AS hops FROM bfs GROUP BY 1)"""


@query("g27_ego", "WITH RECURSIVE " + P.OWNERSHIP + EGO + " SELECT * FROM ego")
def g27(spark, d):
    e = stash(P.ownership(spark, d), "own")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    h = both.groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]
    return graph.ego(e, h, 3)


@query("g28_connected_wallets", "WITH RECURSIVE " + P.OWNERSHIP + EGO + " SELECT node FROM ego WHERE hops > 0 AND node % 2 = 0")
def g28(spark, d):
    return g27(spark, d).where("hops > 0 and node % 2 = 0").select("node")


@query("g31_induced", "WITH RECURSIVE " + P.OWNERSHIP + EGO + " SELECT src, dst FROM own WHERE src IN (SELECT node FROM ego) AND dst IN (SELECT node FROM ego)")
def g31(spark, d):
    return graph.induced(P.ownership(spark, d), g27(spark, d)).select("src", "dst")


@query("g29_chain", "WITH RECURSIVE " + P.PAYMENTS + LIFE + """, s AS (SELECT o.tx_idx AS src, first_spend_tx AS dst FROM outputs o JOIN life USING (addr) WHERE first_spend_tx > o.tx_idx), seed AS (SELECT min(src) AS n FROM s),
 bfs AS (SELECT n AS node, 0 AS d FROM seed UNION SELECT dst, d + 1 FROM bfs JOIN s ON src = node WHERE d < 4) SELECT node, min(d) AS hops FROM bfs GROUP BY 1""")
def g29(spark, d):
    b = Book(spark, d)
    e = heuristics.successors(b.outputs.select("tx_idx", "addr"), b.tx, b.life).select(F.col("tx_idx").alias("src"), F.col("next").alias("dst"))
    e = stash(e, "successors")
    return graph.hops(e, e.agg(F.min("src").alias("node")), 4).select("node", "hops")


@query("g30_common", "WITH " + TRADE + ", n AS (SELECT src AS a, dst AS b FROM trade WHERE (src * dst) % 4 <> 0 UNION SELECT dst, src FROM trade WHERE (src * dst) % 4 <> 0) SELECT CAST(b AS BIGINT) AS node FROM n WHERE a = 1 INTERSECT SELECT b FROM n WHERE a = 7")
def g30(spark, d):
    return graph.common_neighbours(trade(spark, d).where("(src * dst) % 4 <> 0"), 1, 7)


@query("j01_left_label", "SELECT d.doc_id, d.lang, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j01(spark, d):
    return P.table(spark, d, "documents").select("doc_id", "lang").join(P.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")


@query("j02_inner_label", "SELECT d.lang, CAST(sum(l.toxic) AS BIGINT) AS toxic, count(*) AS n FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def j02(spark, d):
    return P.table(spark, d, "documents").select("doc_id", "lang").join(P.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id").groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))


@query("j03_left_fill", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def j03(spark, d):
    n = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return P.table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0)


@query("j06_external_outputs", W + MEMBER + " SELECT tx_idx, pos, entity FROM ext")
def j06(spark, d):
    return Book(spark, d).external.select("tx_idx", F.col("pos").cast("bigint").alias("pos"), "entity")


@query("j07_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j07(spark, d):
    back = P.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.table(spark, d, "orders").select("o_orderkey").join(back, "o_orderkey", "left_semi")


@query("j09_successor", W + LIFE + " SELECT o.tx_idx, first_spend_tx AS next FROM outputs o JOIN life USING (addr) WHERE first_spend_tx > o.tx_idx")
def j09(spark, d):
    b = Book(spark, d)
    return heuristics.successors(b.outputs.select("tx_idx", "addr"), b.tx, b.life)


RANGES = "ranges AS (SELECT n_nationkey, CAST(n_nationkey AS BIGINT) * 160000000 AS lo, CAST(n_nationkey AS BIGINT) * 160000000 + 120000000 AS hi FROM nation), pts AS (SELECT o_orderkey, o_orderkey * 7919 % 4294967296 AS ip FROM orders)"


def _ranges(spark, d):
    n = F.col("n_nationkey").cast("bigint")
    return P.table(spark, d, "nation").select("n_nationkey", (n * 160000000).alias("start"), (n * 160000000 + 120000000).alias("end"))


@query("j10_ip_range", "WITH " + RANGES + " SELECT o_orderkey, ip, n_nationkey FROM pts JOIN ranges ON ip BETWEEN lo AND hi")
def j10(spark, d):
    pts = P.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 4294967296).alias("ip"))
    return correlation.range_join(pts, _ranges(spark, d), "ip").where("n_nationkey is not null").select("o_orderkey", "ip", "n_nationkey")


@query("j11_layered", "WITH " + RANGES + " SELECT o_orderkey, coalesce(n_nationkey, 1000 + ip // 16777216) AS place FROM pts LEFT JOIN ranges ON ip BETWEEN lo AND hi")
def j11(spark, d):
    pts = P.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 4294967296).alias("ip"))
    found = correlation.range_join(pts, _ranges(spark, d), "ip").where("n_nationkey is not null").select("o_orderkey", "n_nationkey")
    return pts.join(found, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.col("n_nationkey").cast("bigint"), 1000 + F.floor(F.col("ip") / 16777216)).alias("place"))


@query("j13_flags", "SELECT event_id, user_id % 9 = 0 AS listed FROM events")
def j13(spark, d):
    e = P.table(spark, d, "events").select("event_id", "user_id")
    listed = e.select("user_id").distinct().where("user_id % 9 = 0").withColumn("hit", F.lit(True))
    return e.join(listed, "user_id", "left").select("event_id", F.col("hit").isNotNull().alias("listed"))


@query("j14_next_flow", "WITH " + P.TELEMETRY + " SELECT a.obs, arg_max(b.obs, (b.amount, -b.obs)) AS next FROM obs a JOIN obs b ON a.entity = b.entity AND b.ts > a.ts GROUP BY 1")
def j14(spark, d):
    o = P.telemetry(spark, d)
    after = Window.partitionBy("entity").orderBy("ts", "obs").rowsBetween(1, Window.unboundedFollowing)
    best = F.max(F.struct("amount", (-F.col("obs")).alias("less"))).over(after)
    return o.select("obs", best.alias("b")).where("b is not null").select("obs", (-F.col("b.less")).alias("next"))


@query("j18_set_difference", "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup' AND event_id % 3 = 0")
def j18(spark, d):
    e = P.table(spark, d, "events")
    return e.where("event_type = 'view'").select("user_id").distinct().join(e.where("event_type = 'signup' and event_id % 3 = 0").select("user_id"), "user_id", "left_anti")


@query("f01_ip_number", "SELECT o_orderkey, o_orderkey * 7919 % 4294967296 AS ip FROM orders")
def f01(spark, d):
    n = P.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 4294967296).alias("n"))
    return n.select("o_orderkey", S.ip_to_int(S.int_to_ip(F.col("n"))).alias("ip"))


#: What thins the trade graph in the SQL above.
THINNED = (" WHERE l_quantity >= 45", " WHERE src < 20", " AND (src + dst) % 3 <> 0", "(src * 3 + dst) % 4 = 0 AND ", " WHERE (src * dst) % 4 <> 0")


def _whole_sql(name):
    sql = ORACLE[name]
    for cut in THINNED:
        sql = sql.replace(cut, "")
    return sql


# The queries on trade() once more, on every trade row and without the filters on edges.


@query("g02_walk_whole", _whole_sql("g02_walk"))
def g02_whole(spark, d):
    return r(graph.normalised(graph.adjacency(trade(spark, d, whole=True))), 8, "p")


@query("g10_edges_whole", _whole_sql("g10_edges"))
def g10_whole(spark, d):
    return r(graph.aggregated_edges(trade(spark, d, whole=True)), 2, "amount")


@query("g12_trail_whole", _whole_sql("g12_trail"))
def g12_whole(spark, d):
    return graph.money_trail(trade(spark, d, whole=True), 5)


@query("g20_pagerank_whole", _whole_sql("g20_pagerank"))
def g20_whole(spark, d):
    return r(graph.pagerank(trade(spark, d, whole=True), steps=8, tolerance=0.0), 9, "rank")


@query("g21_betweenness_whole")
def g21_whole(spark, d):
    return graph.betweenness(trade(spark, d, whole=True))


@query("g22_clustering_whole", _whole_sql("g22_clustering"))
def g22_whole(spark, d):
    return r(graph.clustering(trade(spark, d, whole=True)), 8, "coefficient")


@query("g23_hits_whole")
def g23_whole(spark, d):
    return r(graph.hits(trade(spark, d, whole=True)), 9, "hub", "authority")


@query("g26_simple_paths_whole", _whole_sql("g26_simple_paths"))
def g26_whole(spark, d):
    e = stash(trade(spark, d, whole=True).where("src <> dst").select("src", "dst").distinct(), "dense")
    return graph.simple_paths(e, 0, 8, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"))


@query("g30_common_whole", _whole_sql("g30_common"))
def g30_whole(spark, d):
    return graph.common_neighbours(trade(spark, d, whole=True), 1, 7)
