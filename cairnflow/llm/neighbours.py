"""Approximate nearest neighbours with learned partitions.

On a sample of at most about SAMPLE vectors: the nearest-neighbour graph is cut into balanced partitions, and a small network learns
to tell, from a vector alone, in which partitions its neighbours lie. Where these hold many more than LEAF_ROWS rows each, every one is
cut again in the same way, on a sample of its own vectors, so that partitions grow with the table: up to about (SAMPLE /
PER_PARTITION) squared. Every vector is put into its most probable partition. A query goes to as many of its most probable
partitions as reach TARGET recall on held-out vectors, which neither the cuts nor the networks have seen and whose true neighbours
among all rows are found by one exact scan (all partitions, if need be); everything found there is ranked again by the exact inner
product. Partitions and queries are dealt in blocks of bounded size, so a partition that holds most of the rows is many tasks.

Defined cases: vectors that are null, zero, of another length than most of the sample, or with null or non-finite components take
no part; ties go to the smaller id; rows repeated with the same id count once, with the largest vector in array order; null ids take
no part; with fewer candidates than k all are returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import read, release, stash

SAMPLE = 8_000
GRAPH_K = 10
PER_PARTITION = 250
HIDDEN = 128
EPOCHS = 30
TARGET = 0.95
#: Held-out vectors on which recall is measured, and rows of a partition above which it is cut again.
HELD_OUT, LEAF_ROWS = 300, 8_192
CANDIDATE_BLOCK, QUERY_BLOCK, CHUNK = 8_192, 16_384, 256


def knn(x: np.ndarray, queries: np.ndarray, k: int, block: int = 512) -> np.ndarray:
    """Places of the k vectors of ``x`` with the largest inner product, own place excluded, for the vectors at ``queries``."""
    out = np.empty((len(queries), k), dtype=np.int64)
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        out[at : at + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(graph: np.ndarray, parts: int, rounds: int = 25, slack: float = 1.05) -> np.ndarray:
    """Partition of each node of a neighbour graph. A breadth-first order is cut into equal pieces; then nodes move to the
    partition that holds most of their neighbours, best gains first, while there is room."""
    n, k = graph.shape
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    starts = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    by = np.argsort(starts, kind="stable")
    ends, at = ends[by], np.searchsorted(starts[by], np.arange(n + 1))
    order, seen = [], np.zeros(n, dtype=bool)
    for root in range(n):
        if not seen[root]:
            seen[root] = True
            queue = [root]
            for u in queue:
                for v in ends[at[u] : at[u + 1]]:
                    if not seen[v]:
                        seen[v] = True
                        queue.append(v)
            order += queue
    part = np.empty(n, dtype=np.int64)
    part[order] = np.arange(n) * parts // n
    room = int(np.ceil(n / parts * slack))
    src = np.repeat(np.arange(n), np.diff(at))
    for _ in range(rounds):
        votes = np.bincount(src * parts + part[ends], minlength=n * parts).reshape(n, parts)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if moved < n // 500:
            break
    return part


class Router:
    """A network with one hidden layer that gives the probability of each partition."""

    def __init__(self, dims: int, parts: int, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.w = [draw.normal(size=(dims, HIDDEN)) / np.sqrt(dims), np.zeros(HIDDEN), draw.normal(size=(HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        self.scale = 1.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w[0] + self.w[1], 0)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.w[2] + self.w[3]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 3e-3, batch: int = 256, seed: int = 6) -> Router:
        """Cross entropy against the shares ``y``, by Adam."""
        self.scale = 1.0 / max(1e-12, float(np.sqrt((x * x).mean())))
        m, v, t, draw = [0 * w for w in self.w], [0 * w for w in self.w], 0, np.random.default_rng(seed)
        for epoch in range(epochs):
            for at in np.array_split(draw.permutation(len(x)), max(1, len(x) // batch)):
                h = self.hidden(x[at])
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                d = (p / p.sum(1, keepdims=True) - y[at]) / len(at)
                dh = (d @ self.w[2].T) * (h > 0)
                t += 1
                for i, g in enumerate((x[at].T @ dh * self.scale, dh.sum(0), h.T @ d, d.sum(0))):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self


def fit_router(sample: np.ndarray, most_parts: int) -> Router | None:
    """Cut the neighbour graph of a sample into parts of PER_PARTITION vectors or more and learn to route; None for a single part."""
    n = len(sample)
    parts = min(most_parts, n // PER_PARTITION)
    if parts < 2:
        return None
    graph = knn(sample, np.arange(n), min(GRAPH_K, n - 1))
    part = balanced_partition(graph, parts)
    share = np.zeros((n, parts))
    np.add.at(share, (np.repeat(np.arange(n), graph.shape[1]), part[graph].ravel()), 1 / graph.shape[1])
    share[np.arange(n), part] += 0.5
    return Router(sample.shape[1], parts).fit(sample, share / share.sum(1, keepdims=True))


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


class Index:
    """Routers of one or two levels; ``probes`` partitions are searched, with ``recall`` on held-out queries."""

    def __init__(self, coarse: Router | None):
        self.coarse, self.inner, self.probes, self.recall = coarse, {}, 1, 1.0

    @property
    def parts(self) -> int:
        n = 1 if self.coarse is None else len(self.coarse.w[3])
        return sum(len(self.inner[p].w[3]) if p in self.inner else 1 for p in range(n))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each partition."""
        if self.coarse is None and not self.inner:
            return np.zeros((len(x), 1))
        top = np.zeros((len(x), 1)) if self.coarse is None else log_softmax(self.coarse.logits(x))
        return np.hstack([top[:, [p]] + (log_softmax(self.inner[p].logits(x)) if p in self.inner else 0.0) for p in range(top.shape[1])])

    def route(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m most probable partitions of each vector, best first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :m]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def deep(items: F.Column, k: int) -> F.Column:
    return F.slice(F.array_sort(items), 1, k)


def nearest(found: DataFrame, group: F.Column, k: int, also: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, best): the k nearest of rows (query_id, vec_id, score), met by ``group`` first, so that no list outgrows what one group
    holds or k for each group."""
    each = F.struct((-F.col("score")).alias("less"), "vec_id", "score", *also)
    some = found.groupBy("query_id", group.alias("group")).agg(deep(F.collect_list(each), k).alias("best"))
    return some.groupBy("query_id").agg(deep(F.flatten(F.collect_list("best")), k).alias("best"))


def exact(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, places of its k nearest in ``x``, scores). ``ids`` ascend. Blocks of products choose; scores of what they choose,
    and of what is as near as rounding can tell, are summed once more in one fixed order, so equal vectors tie exactly. Of
    equal vectors only the k + 1 of the smallest ids can be among the k nearest, so the others are left out first."""
    if len(x) > k + 1:
        flat = np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
        _, same = np.unique(flat, return_inverse=True)
        order = np.argsort(same, kind="stable")
        first = np.searchsorted(same[order], same[order], side="left")
        use = np.sort(order[np.arange(len(order)) - first <= k])
        x, ids = x[use], ids[use]
    else:
        use = np.arange(len(x))
    longest = float(np.sqrt((x * x).sum(1).max()))
    for at in range(0, len(queries), CHUNK):
        q = queries[at : at + CHUNK]
        for n, s in enumerate(q @ x.T):
            place = np.searchsorted(ids, own[at + n])
            if place < len(ids) and ids[place] == own[at + n]:
                s[place] = -np.inf
            if len(s) > k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                near = np.flatnonzero(s >= kth - 1e-13 * longest * float(np.sqrt(q[n] @ q[n])))
            else:
                near = np.arange(len(s))
            near = near[s[near] > -np.inf]
            score = (x[near] * q[n]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            yield at + n, use[near[best]], score[best]


def fit(rows: DataFrame, k: int, target: float = TARGET) -> tuple[Index, DataFrame]:
    """The index, and (vec_id, v, part) of all ``rows`` (vec_id, v). Vectors are sampled by a hash of their ids."""
    n, place = rows.count(), F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    cut = int((1 << 20) * min(0.9, SAMPLE / max(n, 1)))
    picked = [r[0] for r in rows.where(place < cut).orderBy("vec_id").select("v").collect()]  # about SAMPLE rows at most
    lengths = np.array([len(x) for x in picked] or [1])
    dims = int(np.bincount(lengths).argmax())
    if not picked:  # a handful of rows
        dims = int((rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first() or [1])[0])
    sample = np.array([x for x in picked if len(x) == dims] or np.zeros((0, dims))).reshape(-1, dims)
    rows = rows.where(F.size("v") == dims)
    index = Index(fit_router(sample, SAMPLE // PER_PARTITION))

    def place_rows(rows: DataFrame) -> DataFrame:
        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    yield f.assign(part=index.scores(np.stack(f["v"].to_numpy())).argmax(1))

        return stash(rows.mapInPandas(assign, "vec_id bigint, v array<double>, part bigint"), "placed")

    placed = place_rows(rows)
    if n > index.parts * LEAF_ROWS and index.parts > 1:
        held = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # SAMPLE / PER_PARTITION rows at most
        rates = F.array(*[F.lit(int((1 << 20) * min(0.9, SAMPLE / held.get(p, 1))) if held.get(p, 0) > LEAF_ROWS else 0) for p in range(index.parts)])

        def cut_again(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("vec_id")
            router = fit_router(np.stack(f["v"].to_numpy()), -(-held[key[0]] // LEAF_ROWS))
            return pd.DataFrame({"part": [key[0]], "router": [pickle.dumps(router)]})

        again = placed.where(place < F.element_at(rates, (F.col("part") + 1).cast("int"))).groupBy("part").applyInPandas(cut_again, "part bigint, router binary")
        found = {r["part"]: pickle.loads(r["router"]) for r in again.collect()}  # a small network for each coarse partition
        index.inner = {p: r for p, r in found.items() if r is not None}
        if index.inner:
            release(placed)
            placed = place_rows(rows)
    if index.parts > 1:
        most = int((1 << 20) * min(0.1, HELD_OUT / n))
        unseen = placed.where(place >= (1 << 20) - most).orderBy("vec_id").select("vec_id", "v").collect()  # about HELD_OUT rows
        if unseen:
            index.probes, index.recall = needed(index, placed, unseen, k, target)
        else:
            index.probes = index.parts
        logging.getLogger(__name__).info("%d partitions, %d probes, recall %.3f on %d held-out vectors", index.parts, index.probes, index.recall, len(unseen))
    return index, placed


def needed(index: Index, placed: DataFrame, unseen: list, k: int, target: float) -> tuple[int, float]:
    """The fewest probes with ``target`` recall over the unseen queries, and that recall: each true neighbour counts at the rank of
    its partition among those of the query."""
    own, q = np.array([r[0] for r in unseen]), np.array([r[1] for r in unseen])

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                f = f.sort_values("vec_id")
                ids, part = f["vec_id"].to_numpy(), f["part"].to_numpy()
                for i, at, score in exact(q, own, np.stack(f["v"].to_numpy()), ids, k):
                    yield pd.DataFrame({"query_id": own[i], "vec_id": ids[at], "score": score, "part": part[at]})

    found = placed.mapInPandas(scan, "query_id bigint, vec_id bigint, score double, part bigint")
    best = nearest(found, F.pmod(F.spark_partition_id(), F.lit(64)), k, ("part",)).select("query_id", F.transform("best", lambda b: b["part"]).alias("parts")).collect()
    ranks = np.argsort(np.argsort(-index.scores(q), axis=1, kind="stable"), axis=1)
    at = np.searchsorted(own, [r["query_id"] for r in best])
    hit = np.concatenate([ranks[i][np.array(r["parts"], dtype=np.int64)] for i, r in zip(at, best, strict=True)])
    share = np.bincount(hit, minlength=index.parts).cumsum() / len(hit)
    probes = min(int(np.searchsorted(share, target)) + 1, index.parts)
    return probes, float(share[probes - 1])


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which ``is_query`` holds, by inner product."""
    index, placed = fit(stash(usable(vectors, id_col, vec_col), "vectors"), k, target)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(parts=list(index.route(np.stack(f["v"].to_numpy()), index.probes)))

    asked = placed.where(is_query(F.col("vec_id"))).select("vec_id", "v").mapInPandas(probe, "vec_id bigint, v array<double>, parts array<bigint>")
    asked = stash(asked.select(F.col("vec_id").alias("query_id"), "v", F.explode("parts").alias("part")), "asked")
    # Sizes of the partitions, of which there are (SAMPLE / PER_PARTITION) squared at most.
    held = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    sought = asked.groupBy("part").agg(F.count(F.lit(1)).alias("q"))
    sizes = F.broadcast(held.join(sought, "part").select("part", F.ceil(F.col("n") / CANDIDATE_BLOCK).alias("blocks"), F.ceil(F.col("q") / QUERY_BLOCK).alias("asks")))
    have = placed.join(sizes, "part").select(
        "part", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("asks") - 1)).alias("ask"), "vec_id", "v"
    )
    want = asked.join(sizes, "part").select(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query_id"), F.col("asks")).alias("ask"), "query_id", "v"
    )

    def block(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out, (part, at_block, _) = [], key
        if len(q) and len(c):
            c = c.sort_values("vec_id")
            ids, own = c["vec_id"].to_numpy(), q["query_id"].to_numpy()
            for i, at, score in exact(np.stack(q["v"].to_numpy()), own, np.stack(c["v"].to_numpy()), ids, k):
                out.append(pd.DataFrame({"query_id": own[i], "part": part, "block": at_block, "vec_id": ids[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "part": [], "block": [], "vec_id": [], "score": []})

    keys = ["part", "block", "ask"]
    found = want.groupBy(*keys).cogroup(have.groupBy(*keys)).applyInPandas(block, "query_id bigint, part bigint, block bigint, vec_id bigint, score double")
    best = nearest(found, F.struct("part", F.floor(F.col("block") / 64).alias("some")), k)
    ranked = best.select("query_id", F.posexplode("best").alias("p", "b"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
