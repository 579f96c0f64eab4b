"""Detectors: forests with calibrated probabilities, isolation scores, embeddings, peer groups, explanations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.durable import stash


def vectors(rows: DataFrame, key: str, array: str, positive: Column) -> DataFrame:
    """(id, features, label)."""
    return rows.select(F.col(key).alias("id"), array_to_vector(F.col(array).cast("array<double>")).alias("features"), positive.cast("double").alias("label"))


def fold_of(group: Column, folds: int) -> Column:
    """Fold of a group from a hash of its name, so that all rows of a group share a fold on any cluster."""
    return (F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def assign_folds(rows: DataFrame, folds: int, key: str = "entity", campaign: str = "campaign") -> DataFrame:
    """``rows`` with fold: rows of a campaign (0 or more) share one, others have one by their key."""
    own, shared = F.concat(F.lit("e"), F.col(key).cast("string")), F.concat(F.lit("c"), F.col(campaign).cast("string"))
    return rows.withColumn("fold", fold_of(F.when(F.coalesce(campaign, F.lit(-1)) >= 0, shared).otherwise(own), folds))


def balanced(train: DataFrame) -> DataFrame:
    n = train.agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).first()
    p, all_rows = n["p"] or 0.0, n["n"] or 1
    return train.withColumn("weight", F.when(F.col("label") == 1, all_rows / (2 * max(p, 1.0))).otherwise(all_rows / (2 * max(all_rows - p, 1.0))))


def forest(train: DataFrame, trees: int = 100, seed: int = 42):
    return RandomForestClassifier(numTrees=trees, minInstancesPerNode=2, maxDepth=8, weightCol="weight", seed=seed, featuresCol="features", labelCol="label").fit(balanced(train))


def logistic(train: DataFrame):
    return LogisticRegression(weightCol="weight", regParam=0.01).fit(balanced(train))


def cross_fitted(rows: DataFrame, trees: int = 100, folds: int = 2, group: str = "id") -> DataFrame:
    """(id, fold, p, calibrated): each fold is scored by a forest of the other folds; an isotonic fit of those out-of-fold scores
    calibrates them. A fold whose training rows hold fewer than two positives gets null."""
    rows = stash(rows.withColumn("fold", fold_of(F.col(group), folds)), "folds")
    out = None
    for k in range(folds):
        train, test = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if train.where("label = 1").limit(2).count() < 2:
            part = test.select("id", "fold", "label", F.lit(None).cast("double").alias("p"))
        else:
            part = forest(train, trees).transform(test).select("id", "fold", "label", vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    out = stash(out, "oof")
    known = out.where(F.col("p").isNotNull())
    if not known.limit(1).count():
        return out.select("id", "fold", "p", F.col("p").alias("calibrated"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(known)
    return iso.transform(known).select("id", "fold", "p", F.col("prediction").alias("calibrated")).unionByName(out.where(F.col("p").isNull()).select("id", "fold", "p", F.col("p").alias("calibrated")))


def probability(model, rows: DataFrame) -> DataFrame:
    """(id, p) of (id, features)."""
    return model.transform(rows).select("id", vector_to_array("probability")[1].alias("p"))


def out_of_fold(rows: DataFrame, trees: int = 100, max_negatives: int = 40_000) -> DataFrame:
    """(id, fold, label, p, calibrated) of (id, features, label, fold), labels partly null: each fold is scored, labelled or not, by a forest
    of the labelled rows of the others; an isotonic fit of the labelled rows' scores calibrates. A fold whose training rows hold
    fewer than two positives gets null."""
    rows = stash(rows, "folds")
    out = None
    for k in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):
        train, test = rows.where((F.col("fold") != k) & F.col("label").isNotNull()), rows.where(F.col("fold") == k)
        if train.where("label = 1").limit(2).count() < 2:
            part = test.select("id", "fold", "label", F.lit(None).cast("double").alias("p"))
        else:
            part = forest(negatives_capped(train, max_negatives), trees).transform(test).select("id", "fold", "label", vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.select("id", "fold", "label", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("calibrated"))
    out = stash(out, "oof")
    known = out.where("p is not null and label is not null")
    if not known.take(1):
        return out.withColumn("calibrated", F.col("p"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(known)
    some = iso.transform(out.where("p is not null")).select("id", "fold", "label", "p", F.col("prediction").alias("calibrated"))
    return some.unionByName(out.where("p is null").withColumn("calibrated", F.col("p")))


def tree_spread(model, rows: DataFrame) -> DataFrame:
    """(id, mean, low, high): 90 % interval from the spread of the trees' votes."""
    votes = F.array(*[F.lit(0.0)])
    scored = rows
    names = []
    for i, t in enumerate(model.trees):
        t = t.copy().setProbabilityCol(f"p{i}").setRawPredictionCol(f"r{i}").setPredictionCol(f"y{i}")
        scored = t.transform(scored).drop(f"r{i}", f"y{i}")
        names.append(vector_to_array(f"p{i}")[1])
    votes = F.array(*names)
    n = len(names)
    mean = F.aggregate(votes, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.sqrt(F.aggregate(votes, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return scored.select("id", mean.alias("mean"), clip(mean - 1.645 * spread).alias("low"), clip(mean + 1.645 * spread).alias("high"))


def occlusion(model, rows: DataFrame, medians: list[float], names: list[str], top: int = 6, least: float = 0.005, families: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, feature, effect): how much the probability falls when a feature is set to its median; the largest of each row. With
    ``families`` (name: its features), whole families are set to their medians instead."""
    x = vector_to_array("features")
    base = model.transform(rows).select("id", x.alias("x"), vector_to_array("probability")[1].alias("p"))
    groups = {n: [n] for n in names} if families is None else families
    at = {n: i for i, n in enumerate(names)}
    sets = F.array(*[F.struct(F.lit(k).alias("feature"), F.array(*[F.lit(at[n]) for n in v]).alias("places")) for k, v in groups.items()])
    masked = base.select("id", "p", F.explode(sets).alias("g"), "x")
    med = F.array(*[F.lit(float(m)) for m in medians])
    hidden = F.transform("x", lambda v, j: F.when(F.array_contains(F.col("g")["places"], j), F.element_at(med, j + 1)).otherwise(v))
    masked = masked.select("id", "p", F.col("g")["feature"].alias("feature"), array_to_vector(hidden).alias("features"))
    got = model.transform(masked).select("id", "feature", (F.col("p") - vector_to_array("probability")[1]).alias("effect"))
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc(F.abs("effect")), "feature")
    return got.where(F.abs("effect") >= least).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).drop("rn")


def importances(model, names: list[str], prefix: str | None = None, group: str = "embedding") -> list[tuple[str, float]]:
    """(feature, importance), largest first; features that begin with ``prefix`` are summed as ``group``."""
    sums: dict[str, float] = {}
    for n, v in zip(names, model.featureImportances.toArray().tolist(), strict=True):
        key = group if prefix and n.startswith(prefix) else n
        sums[key] = sums.get(key, 0.0) + v
    return sorted(sums.items(), key=lambda x: (-x[1], x[0]))


class IsolationForest:
    """Random split trees on small samples; the anomaly of a row grows as its paths get shorter."""

    def __init__(self, sample: np.ndarray, trees: int = 200, size: int = 256, seed: int = 42):
        draw = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        self.trees = [self._grow(sample[draw.choice(len(sample), self.size, replace=False)], draw, int(np.ceil(np.log2(max(2, self.size))))) for _ in range(trees)]

    @staticmethod
    def average(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, draw, depth: int):
        if depth == 0 or len(x) < 2:  # a split between neighbouring floats may leave a side empty
            return self.average(len(x))
        low, high = x.min(0), x.max(0)
        open_ = np.flatnonzero(high > low)
        if not len(open_):
            return self.average(len(x))
        f = int(draw.choice(open_))
        at = float(draw.uniform(low[f], high[f]))
        left = x[:, f] < at
        return f, at, self._grow(x[left], draw, depth - 1), self._grow(x[~left], draw, depth - 1)

    def _paths(self, tree, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
        if isinstance(tree, tuple):
            left = x[rows, tree[0]] < tree[1]
            self._paths(tree[2], x, rows[left], depth + 1, out)
            self._paths(tree[3], x, rows[~left], depth + 1, out)
        else:
            out[rows] += depth + tree

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            self._paths(t, x, np.arange(len(x)), 0, out)
        return 2 ** (-out / len(self.trees) / max(self.average(self.size), 1e-9))


def isolation_transform(train: DataFrame, rows: DataFrame, trees: int = 200, sample_rows: int = 4096, seed: int = 42) -> DataFrame:
    """(id, score) of (id, x). Trees are grown on the driver from a sample of about ``sample_rows`` training rows at most, chosen by hash;
    each tree takes 256 of them."""
    n = train.count()
    take = train if n <= sample_rows else train.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    sample = np.array([r["x"] for r in take.orderBy("id").select("x").collect()])
    kind = rows.schema["id"].dataType.simpleString()
    if not len(sample):
        return rows.select("id", F.lit(0.5).alias("score"))
    model = IsolationForest(sample, trees, seed=seed)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "score": model.score(np.stack(f["x"].to_numpy()))})

    return rows.select("id", "x").mapInPandas(score, f"id {kind}, score double")


def isolation_scores(rows: DataFrame, trees: int = 200, sample_rows: int = 4096) -> DataFrame:
    """(id, anomaly, percentile) of (id, x)."""
    from cairnflow.operators.metrics import percentile_rank

    scored = stash(isolation_transform(rows, rows, trees, sample_rows), "isolation")
    return percentile_rank(scored).select("id", F.col("score").alias("anomaly"), "percentile")


def min_max(rows: DataFrame, column: str) -> DataFrame:
    """The column scaled to [0, 1]; 0.5 where it is flat."""
    ends = rows.agg(F.min(column).alias("__low"), F.max(column).alias("__high"))
    span = F.col("__high") - F.col("__low")
    return rows.join(F.broadcast(ends)).withColumn(column, F.when(span > 0, (F.col(column) - F.col("__low")) / span).otherwise(0.5)).drop("__low", "__high")


def temporal_split(rows: DataFrame, step: str, last_train: int) -> DataFrame:
    return rows.withColumn("part", F.when(F.col(step) <= last_train, "train").otherwise("test"))


def negatives_capped(train: DataFrame, most: int = 40_000) -> DataFrame:
    """All positives, and about ``most`` negatives at most, chosen by hash."""
    n = train.where("label = 0").count()
    if n <= most:
        return train
    return train.where((F.col("label") == 1) | (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * most / n)))


def ppmi_embedding(flow: DataFrame, dims: int = 16, rounds: int = 8, seed: int = 1) -> DataFrame:
    """(node, embedding): truncated factors of the positive pointwise mutual information of one- and two-step walks.

    The matrix stays an edge table; subspace iteration multiplies it with a tall thin matrix of node vectors, and only the small
    dims x dims Gram matrix is solved on the driver."""
    from cairnflow.operators.graph import adjacency, normalised

    p = stash(normalised(adjacency(flow)), "walk")
    two = p.select("src", F.col("dst").alias("mid"), F.col("p").alias("a")).join(p.select(F.col("src").alias("mid"), "dst", F.col("p").alias("b")), "mid").groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("p"))
    m = stash(p.select("src", "dst", "p").unionByName(two).groupBy("src", "dst").agg(F.sum("p").alias("m")), "m")
    total = m.agg(F.sum("m")).first()[0] or 1.0
    rs, cs = m.groupBy("src").agg(F.sum("m").alias("r")), m.groupBy("dst").agg(F.sum("m").alias("c"))
    e = m.join(rs, "src").join(cs, "dst").select("src", "dst", F.log(F.col("m") * total / (F.col("r") * F.col("c"))).alias("v")).where("v > 0")
    e = stash(e, "ppmi")
    nodes = m.select(F.col("src").alias("node")).union(m.select("dst")).distinct()
    parts = lambda: [((F.pmod(F.xxhash64("node", F.lit(seed + i)), F.lit(2001)) - 1000) / 1000.0).alias(f"x{i}") for i in range(dims)]
    x = stash(nodes.select("node", *parts()), "x")
    cols = [f"x{i}" for i in range(dims)]

    def times(edges: DataFrame, a: str, b: str, v: DataFrame) -> DataFrame:
        return edges.join(v.withColumnRenamed("node", b), b).groupBy(F.col(a).alias("node")).agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in cols])

    def orthogonal(v: DataFrame) -> tuple[DataFrame, np.ndarray]:
        v = stash(v, "x")
        pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
        g = v.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).first()
        gram = np.zeros((dims, dims))
        for (i, j), value in zip(pairs, g, strict=True):
            gram[i, j] = gram[j, i] = value or 0.0
        w, u = np.linalg.eigh(gram)
        w = np.maximum(w, 1e-12)
        back = u / np.sqrt(w)
        return v.select("node", *[sum((F.col(cols[i]) * float(back[i, j]) for i in range(dims)), F.lit(0.0)).alias(cols[j]) for j in range(dims)]), w

    size = np.ones(dims)
    for _ in range(rounds):
        x, _ = orthogonal(times(e, "dst", "src", x))
        x, size = orthogonal(times(e, "src", "dst", x))
    scale = np.sqrt(np.sqrt(size))
    return nodes.join(x, "node", "left").select("node", F.array(*[F.coalesce(F.col(c), F.lit(0.0)) * float(s) for c, s in zip(cols, scale, strict=True)]).alias("embedding"))


def peer_groups(rows: DataFrame, key: str, columns: list[str], k: int = 8, clip: float = 0.005, seed: int = 42, active: Column | None = None, top: int = 3) -> tuple[DataFrame, DataFrame]:
    """((key, peer_group), (peer_group, size, distinguishing)): k-means on clipped, standardised features of the active rows; -1 for
    the others, and for all where there are fewer than five a group. distinguishing has the ``top`` features (feature, z, direction)
    farthest from the mean."""
    rows = stash(rows.withColumn("__on", F.lit(True) if active is None else F.coalesce(active, F.lit(False))), "peers")
    on, spark = rows.where("__on"), rows.sparkSession
    if on.limit(k * 5).count() < k * 5:
        none = spark.createDataFrame([], "peer_group int, size bigint, distinguishing array<struct<feature:string,z:double,direction:string>>")
        return rows.select(key, F.lit(-1).alias("peer_group")), none
    ends = on.agg(*[F.percentile_approx(c, F.array(F.lit(clip), F.lit(1 - clip)), F.lit(10_000)).alias(c) for c in columns]).first()
    clipped = on.select(key, *[F.greatest(F.lit(float(ends[c][0])), F.least(F.lit(float(ends[c][1])), F.col(c).cast("double"))).alias(c) for c in columns])
    raw = VectorAssembler(inputCols=columns, outputCol="raw").transform(clipped)
    scaled = stash(StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(raw).transform(raw).select(key, "features"), "scaled")
    model = KMeans(k=k, seed=seed, maxIter=20).fit(scaled)
    found = stash(model.transform(scaled).select(key, F.col("prediction").alias("peer_group"), "features"), "groups")
    names = F.array(*[F.lit(c) for c in columns])
    each = found.select("peer_group", F.posexplode(vector_to_array("features")).alias("i", "v")).groupBy("peer_group", "i").agg(F.avg("v").alias("z"))
    item = F.struct((-F.abs("z")).alias("o"), F.element_at(names, F.col("i") + 1).alias("feature"), "z", F.when(F.col("z") > 0, "high").otherwise("low").alias("direction"))
    described = each.groupBy("peer_group").agg(F.slice(F.array_sort(F.collect_list(item)), 1, top).alias("x"))  # one item a column
    described = found.groupBy("peer_group").agg(F.count(F.lit(1)).alias("size")).join(described, "peer_group")
    described = described.select("peer_group", "size", F.transform("x", lambda i: F.struct(i["feature"].alias("feature"), i["z"].alias("z"), i["direction"].alias("direction"))).alias("distinguishing"))
    return rows.select(key).join(found.select(key, "peer_group"), key, "left").select(key, F.coalesce("peer_group", F.lit(-1)).alias("peer_group")), described


def rule_score(*flags: Column) -> Column:
    """Share of the flags that hold."""
    out = F.lit(0)
    for f in flags:
        out = out + F.coalesce(f, F.lit(False)).cast("int")
    return out / len(flags)
