"""Graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.config import GraphConfig
from cairnflow.durable import stash

C = GraphConfig()


def adjacency(flow: DataFrame, c: GraphConfig = C) -> DataFrame:
    """(src, dst, w): 1 + ln(1 + amount), the strongest of each source, made symmetric, and the strongest of each node."""
    pairs = flow.where("src <> dst").groupBy("src", "dst").agg(F.sum("amount").alias("amount")).select("src", "dst", (1 + F.log1p("amount")).alias("w"))
    strongest = lambda df, n: df.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where(F.col("rn") <= n).drop("rn")
    top = strongest(pairs, c.per_source)
    both = top.unionByName(top.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return strongest(both, c.per_node)


def normalised(adj: DataFrame) -> DataFrame:
    total = adj.groupBy("src").agg(F.sum("w").alias("t"))
    return adj.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p"))


def propagate(walk: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """(node, ...): mean of the neighbours' values by walk weights; 0 for a missing value."""
    return walk.join(values.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(*[F.sum(F.col("p") * F.coalesce(c, F.lit(0.0))).alias(c) for c in columns])


def random_walk(walk: DataFrame, seeds: DataFrame, absorbing: DataFrame | None = None, c: GraphConfig = C, steps: int | None = None) -> DataFrame:
    """(node, rank): personalised PageRank with a fixed number of steps. Absorbing nodes pass nothing on, seeds excepted; mass that
    reaches a node without edges is lost."""
    if absorbing is not None:
        stop = absorbing.join(seeds, "node", "left_anti").select(F.col("node").alias("src"))
        walk = walk.join(stop, "src", "left_anti")
    walk = stash(walk, "walk")
    n = seeds.count()
    start = stash(seeds.select("node", F.lit(1.0 / max(1, n)).alias("r0")), "seeds")
    rank = start.select("node", F.col("r0").alias("rank"))
    for step in range(c.walk_steps if steps is None else steps):
        moved = walk.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        rank = moved.join(start, "node", "full_outer").select("node", ((1 - c.restart) * F.coalesce("got", F.lit(0.0)) + c.restart * F.coalesce("r0", F.lit(0.0))).alias("rank"))
        if step % 4 == 3:
            rank = stash(rank, "rank")
    return rank


def hops(edges: DataFrame, seeds: DataFrame, limit: int = C.max_hops, absorbing: DataFrame | None = None) -> DataFrame:
    """(node, hops, nearest): fewest steps from a seed along outgoing edges, ties to the smallest seed. Absorbing nodes are reached
    but not left, seeds excepted."""
    e = edges.select("src", "dst").distinct()
    if absorbing is not None:
        e = e.join(absorbing.join(seeds, "node", "left_anti").select(F.col("node").alias("src")), "src", "left_anti")
    e = stash(e, "steps")
    seen = stash(seeds.select("node", F.lit(0).alias("hops"), F.col("node").alias("nearest")), "seen")
    for step in range(1, limit + 1):
        front = seen.where(F.col("hops") == step - 1).select(F.col("node").alias("src"), "nearest")
        new = e.join(front, "src").groupBy(F.col("dst").alias("node")).agg(F.min("nearest").alias("nearest")).join(seen, "node", "left_anti")
        new = stash(new.select("node", F.lit(step).alias("hops"), "nearest"), "front")
        if not new.limit(1).count():
            break
        seen = seen.unionByName(new)
    return seen


def gated(near: DataFrame, rank: DataFrame, seeds: DataFrame, hubs: DataFrame) -> DataFrame:
    """(node, hops, nearest, risk, is_seed) of the nodes that a walk from the seeds reaches within the hops: 1 for seeds, 0 for hubs, else
    the rank over that of the median seed, 1 at most."""
    typical = rank.join(seeds, "node").agg(F.percentile("rank", F.lit(0.5))).first()[0] or 0.0
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("rank", F.lit(0.0)) / typical)) if typical > 0 else F.lit(0.0)
    rows = near.join(rank, "node", "left").join(hubs.select("node", F.lit(True).alias("hub")), "node", "left")
    risk = F.when(F.col("hops") == 0, 1.0).when(F.col("hub").isNotNull(), 0.0).otherwise(scaled)
    return rows.select("node", "hops", "nearest", risk.alias("risk"), (F.col("hops") == 0).alias("is_seed"))


def seed_risk(flow: DataFrame, seeds: DataFrame, hubs: DataFrame, c: GraphConfig = C, steps: int | None = None) -> DataFrame:
    """(node, hops, nearest, risk, is_seed): risk that spreads from known nodes along the strongest flows."""
    walk = stash(normalised(adjacency(flow, c)), "walk")
    rank = stash(random_walk(walk, seeds, hubs, c, steps), "rank")
    return gated(hops(walk, seeds, c.max_hops, hubs), rank, seeds, hubs)


def structural_indicator(counts: DataFrame) -> DataFrame:
    """(node, x): 1 for entities of (node, peel_chain_txs, layering_chain_txs, dust_spray_txs) that took part in any of the patterns."""
    hit = (F.col("peel_chain_txs") > 0) | (F.col("layering_chain_txs") > 0) | (F.col("dust_spray_txs") > 0)
    return counts.select("node", F.coalesce(hit, F.lit(False)).cast("double").alias("x"))


def neighbourhood(edges: DataFrame, centre, radius: int = 2, max_nodes: int = 60, hubs: DataFrame | None = None) -> DataFrame:
    """(node, hops): the centre and, step by step, the neighbours of most value either way while there is room (ties to the smaller
    node). Hubs are kept but not expanded, the centre excepted. ``edges`` are summed ones (src, dst, amount); at most ``max_nodes``
    nodes are taken from the cluster."""
    kept, front = {centre: 0}, [centre]
    stop = set() if hubs is None else {r["node"] for r in hubs.join(neighbour_nodes(edges, centre), "node", "left_semi").limit(max_nodes).collect()}
    for step in range(1, radius + 1):
        room = max_nodes - len(kept)
        front = [n for n in front if n == centre or n not in stop]
        if room <= 0 or not front:
            break
        out = edges.where(F.col("src").isin(front)).select(F.col("dst").alias("node"), "amount")
        into = edges.where(F.col("dst").isin(front) & ~F.col("src").isin(front)).select(F.col("src").alias("node"), "amount")
        new = out.unionByName(into).where(~F.col("node").isin(list(kept))).groupBy("node").agg(F.sum("amount").alias("amount")).orderBy(F.desc("amount"), "node").limit(room)
        if hubs is not None:
            new = new.join(hubs.select("node", F.lit(True).alias("hub")), "node", "left")
            rows = new.collect()
            stop |= {r["node"] for r in rows if r["hub"]}
        else:
            rows = new.collect()
        front = [r["node"] for r in rows]
        kept |= dict.fromkeys(front, step)
    return edges.sparkSession.createDataFrame(list(kept.items()), f"node {edges.schema['src'].dataType.simpleString()}, hops int")


def neighbour_nodes(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node).select(F.col("dst").alias("node")).unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("node"))).distinct()


def path_edges(edges: DataFrame, path: list | None) -> DataFrame:
    """(step, src, dst, relationship, is_synthetic, confidence): the first edge (smallest relationship) between neighbouring nodes of a
    path; no rows without a path."""
    steps = list(enumerate(zip(path or [], (path or [])[1:], strict=False)))
    wanted = edges.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in steps], f"step int, src {edges.schema['src'].dataType.simpleString()}, dst {edges.schema['dst'].dataType.simpleString()}")
    found = edges.join(F.broadcast(wanted), ["src", "dst"])  # a row for each step of one path
    first = F.min(F.struct("relationship", "is_synthetic", "confidence")).alias("x")
    return found.groupBy("step", "src", "dst").agg(first).select("step", "src", "dst", "x.*")


def scale_free(spark, n: int, m: int = 8, seed: int = 3) -> DataFrame:
    """(src, dst): a graph of ``n`` nodes grown by preferential attachment, each node with ``m`` edges to earlier ones (fewer where
    draws repeat). Every edge is drawn on its own: its end is the node at a random earlier place in the list of all edge ends, and
    a place that is itself drawn is drawn again from its own hash, so no edge waits for another."""
    draw = lambda at: F.pmod(F.xxhash64(F.lit(seed), at), at)  # noqa: E731  a place before ``at``
    e = spark.range(m, n * m).select(F.col("id").alias("e"))
    start = draw(F.col("e") * 2 + 1)
    place = F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, lambda p, _: F.when(p % 2 == 1, draw(p)).otherwise(p))
    rows = e.select(F.floor(F.col("e") / m).alias("src"), F.floor(place / 2 / m).alias("dst"))
    return rows.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def degree_stats(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, mean_degree, max_degree, density) of an undirected simple graph."""
    deg = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    s = deg.agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("d") / 2).cast("bigint").alias("n_edges"), F.avg("d").alias("mean_degree"), F.max("d").alias("max_degree"))
    n = F.col("n_nodes")
    return s.withColumn("density", F.when(n > 1, 2 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0))


def aggregated_edges(flow: DataFrame) -> DataFrame:
    return flow.groupBy("src", "dst").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_tx"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def money_trail(flow: DataFrame, start, limit: int = 15, hubs: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """(step, src, dst, amount, ts): from ``start``, time and again the largest flow that is strictly later (earlier, if backward) to a
    node not visited yet; it ends at a hub. One row is taken from the cluster a step."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    at, when, seen, out = start, None, [start], []
    for step in range(limit):
        nxt = flow.where((F.col(a) == at) & ~F.col(b).isin(seen))
        if when is not None:
            nxt = nxt.where(F.col("ts") < when if backward else F.col("ts") > when)
        row = nxt.orderBy(F.desc("amount"), F.asc("ts"), F.asc("tx_idx"), F.asc(b)).first()
        if row is None:
            break
        out.append((step, row["src"], row["dst"], row["amount"], row["ts"]))
        at, when = row[b], row["ts"]
        seen.append(at)
        if hubs is not None and hubs.where(F.col("node") == at).limit(1).count():
            break
    return flow.sparkSession.createDataFrame(out, "step int, src bigint, dst bigint, amount double, ts bigint")


def _nodes(edges: DataFrame, *nodes) -> DataFrame:
    """(node) of the type that the edges' ends have."""
    return edges.sparkSession.createDataFrame([(n,) for n in nodes], f"node {edges.schema['src'].dataType.simpleString()}")


def incident(edges: DataFrame, node, relationship: str | None = None) -> DataFrame:
    """Outgoing edges, then incoming ones; a self loop appears twice."""
    e = edges if relationship is None else edges.where(F.col("relationship") == relationship)
    return e.where(F.col("src") == node).unionAll(e.where(F.col("dst") == node))


def neighbours(edges: DataFrame, node, direction: str = "both", relationship: str | None = None) -> DataFrame:
    e = edges if relationship is None else edges.where(F.col("relationship") == relationship)
    out, into = e.where(F.col("src") == node).select(F.col("dst").alias("node")), e.where(F.col("dst") == node).select(F.col("src").alias("node"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction].distinct()


def degree_features(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, by_relationship) with parallel edges counted."""
    ends = edges.select(F.col("src").alias("node"), "relationship", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), "relationship", F.lit(0).alias("o"), F.lit(1).alias("i")))
    per = ends.groupBy("node", "relationship").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return per.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("relationship", F.col("i") + F.col("o"))))).alias("by_relationship"))


def pagerank(edges: DataFrame, alpha: float = 0.85, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): parallel edges add up, and the mass of nodes without outgoing edges is spread evenly."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    nodes = stash(nodes, "nodes")
    n = nodes.count()
    w = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    walk = stash(normalised(w), "walk")
    out = walk.select(F.col("src").alias("node")).distinct()
    rank = stash(nodes.select("node", F.lit(1.0 / max(1, n)).alias("rank")), "rank")
    for _ in range(steps):
        loose = rank.join(out, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        moved = walk.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        new = stash(rank.join(moved, "node", "left").select("node", F.col("rank").alias("old"), (alpha * (F.coalesce("got", F.lit(0.0)) + loose / n) + (1 - alpha) / n).alias("rank")), "rank")
        off = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        rank = new.select("node", "rank")
        if off < n * tolerance:
            break
    return rank


def hits(edges: DataFrame, steps: int = 50) -> DataFrame:
    """(node, hub, authority), each summing to 1, by power iteration."""
    e = stash(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "edges")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    hub = nodes.select("node", F.lit(1.0).alias("h"))
    auth = None
    scale = lambda df, c: df.select("node", (F.col(c) / float(df.agg(F.sum(c)).first()[0] or 1.0)).alias(c))
    for _ in range(steps):
        auth = scale(stash(e.join(hub.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("h")).alias("a")), "auth"), "a")
        hub = scale(stash(e.join(auth.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("a")).alias("h")), "hub"), "h")
    return nodes.join(hub, "node", "left").join(auth, "node", "left").select("node", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"))


def simple_undirected(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """(node, coefficient) on the simple undirected graph. Each edge points from the end of smaller degree, so that wedges at hubs
    aren't listed."""
    e = stash(simple_undirected(edges), "simple")
    ends = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node")))
    deg = stash(ends.groupBy("node").agg(F.count(F.lit(1)).alias("d")), "degrees")
    da, db = deg.select(F.col("node").alias("a"), F.col("d").alias("da")), deg.select(F.col("node").alias("b"), F.col("d").alias("db"))
    first = F.struct("da", "a") < F.struct("db", "b")
    o = e.join(da, "a").join(db, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("v"))
    o = stash(o, "oriented")
    wedge = o.select("u", F.col("v").alias("x")).join(o.select("u", F.col("v").alias("y")), "u").where("x < y")
    tri = wedge.join(e, (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")))
    per = tri.select(F.explode(F.array("u", "x", "y")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    d = F.col("d")
    return deg.join(per, "node", "left").select("node", F.when(d >= 2, 2 * F.coalesce("t", F.lit(0)) / (d * (d - 1))).otherwise(0.0).alias("coefficient"))


def shortest_path(edges: DataFrame, source, target, limit: int = 20) -> list | None:
    """Nodes of a directed shortest path (each step from the smallest predecessor), None if there is none within the limit."""
    if source == target:
        return [source]
    e = edges.select("src", "dst").distinct()
    seen = _nodes(edges, source).select("node", F.lit(None).cast(edges.schema["src"].dataType).alias("prev"), F.lit(0).alias("d"))
    for d in range(1, limit + 1):
        new = e.join(seen.where(F.col("d") == d - 1).select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("prev")).join(seen, "node", "left_anti")
        new = stash(new.select("node", "prev", F.lit(d).alias("d")), "front")
        if not new.limit(1).count():
            return None
        seen = seen.unionByName(new)
        if new.where(F.col("node") == target).limit(1).count():
            path = [target]
            while path[-1] != source:
                path.append(seen.where(F.col("node") == path[-1]).first()["prev"])
            return path[::-1]
    return None


def simple_paths(edges: DataFrame, source, target, cutoff: int = 6) -> DataFrame:
    """(path): all simple paths of at most ``cutoff`` steps."""
    e = edges.select("src", "dst").distinct()
    at = e.where(F.col("src") == source).select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    found = at.where(F.col("end") == target).select("path")
    for _ in range(cutoff - 1):
        at = at.where(F.col("end") != target).join(e, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("end"))
        found = found.unionByName(at.where(F.col("end") == target).select("path"))
    return found


def ego(edges: DataFrame, centre, radius: int = 1) -> DataFrame:
    """(node, hops) within ``radius`` steps of either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return hops(both, _nodes(edges, centre), radius).select("node", "hops")


def first_nodes(edges: DataFrame, centre, radius: int = 1, max_nodes: int = 100, relationship: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((node, hops), edges): the first ``max_nodes`` nodes around a centre, nearest first, and the edges among them; a relationship
    filters edges, not nodes."""
    nodes = ego(edges, centre, radius).orderBy("hops", "node").limit(max_nodes)
    inside = induced(edges, nodes)
    return nodes, inside if relationship is None else inside.where(F.col("relationship") == relationship)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def common_neighbours(edges: DataFrame, a, b) -> DataFrame:
    return neighbours(edges, a).intersect(neighbours(edges, b))


def betweenness(edges: DataFrame, sources: int | None = None) -> DataFrame:
    """(node, betweenness) of the directed simple graph, unnormalised: for each source, shortest paths are counted breadth first and
    dependencies are summed back. Sources are dealt over the cluster; each task holds the edge list, so the graph must be one that fits a task
    (a bounded subgraph). ``sources`` takes that many by hash and scales up."""
    import pandas as pd

    e = edges.where("src <> dst").select("src", "dst").distinct()
    e = stash(e, "simple")
    if e.limit(2_000_001).count() > 2_000_000:
        raise ValueError("betweenness needs a bounded subgraph of two million edges at most")
    ends: dict = {}
    for r in e.toLocalIterator():
        ends.setdefault(r["src"], []).append(r["dst"])
    shared = edges.sparkSession.sparkContext.broadcast(ends)  # two million edges at most, as counted
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    n = nodes.count()
    picked = nodes if sources is None or sources >= n else nodes.orderBy(F.xxhash64("node")).limit(sources)

    def one(frames):
        out = shared.value
        for f in frames:
            total: dict = {}
            for s in f["node"]:
                paths, dist, order, before = {s: 1.0}, {s: 0}, [s], {}
                for u in order:
                    for v in out.get(u, ()):
                        if v not in dist:
                            dist[v] = dist[u] + 1
                            order.append(v)
                        if dist[v] == dist[u] + 1:
                            paths[v] = paths.get(v, 0.0) + paths[u]
                            before.setdefault(v, []).append(u)
                need = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in before.get(v, ()):
                        need[u] += paths[u] / paths[v] * (1 + need[v])
                    if v != s:
                        total[v] = total.get(v, 0.0) + need[v]
            yield pd.DataFrame({"node": list(total), "b": list(total.values())})

    sums = picked.repartition(16, "node").mapInPandas(one, "node bigint, b double").groupBy("node").agg(F.sum("b").alias("b"))
    scale = 1.0 if sources is None or sources >= n else n / sources
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))
