"""Detectors of labelled transactions: feature sets, splits and their audit, training, comparison, rolling origins and perturbation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.durable import release, stash
from cairnflow.operators import forest, metrics, ml, risk

#: Names of the interpretable transaction features.
INTERPRETABLE = (
    "in_txs_degree", "out_txs_degree", "total_BTC", "fees", "size", "num_input_addresses", "num_output_addresses", "in_BTC_min", "in_BTC_max", "in_BTC_mean", "in_BTC_median", "in_BTC_total",
    "out_BTC_min", "out_BTC_max", "out_BTC_mean", "out_BTC_median", "out_BTC_total",
)
#: Names of the graph and network features.
GRAPH = ("in_degree", "out_degree", "total_degree", "pagerank", "betweenness_centrality", "clustering_coefficient", "hub_score", "authority_score")
NETWORK = ("num_observations", "num_unique_src_ips", "num_unique_dst_ips", "num_unique_countries", "num_unique_asns", "mean_propagation_delay_ms", "max_propagation_delay_ms", "uses_tor", "uses_vpn")
#: Columns that no feature set may hold.
FORBIDDEN = frozenset({"txId", "txid", "address", "class", "label", "time_step", "Time step"})
ANONYMOUS = (*(f"Local_feature_{i}" for i in range(1, 94)), *(f"Aggregate_feature_{i}" for i in range(1, 73)))
FEATURE_SETS = {"M1": (*ANONYMOUS, *INTERPRETABLE), "M2": (*ANONYMOUS, *INTERPRETABLE, *GRAPH), "M3": (*ANONYMOUS, *INTERPRETABLE, *GRAPH, *NETWORK)}
LAST_TRAIN_STEP = 34
KS = (10, 25, 50, 100)


def features_of(name: str, columns: Iterable[str]) -> list[str]:
    """The features of a set that are among the columns; unknown sets raise KeyError."""
    have = set(columns)
    return [c for c in FEATURE_SETS[name] if c in have]


def supervised(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows of label 1 (illicit) and 2 (licit), with target 1 and 0."""
    return rows.where(F.col(label).isin(1, 2)).withColumn("target", (F.col(label) == 1).cast("int"))


def temporal_split(rows: DataFrame, last_train: int = LAST_TRAIN_STEP, step: str = "time_step", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(train, test) of the supervised rows, by step; missing columns and an empty side raise ValueError."""
    for c in (step, label):
        if c not in rows.columns:
            raise ValueError(f"column {c!r} is missing")
    known = supervised(rows, label)
    n = known.agg(F.count_if(F.col(step) <= last_train).alias("a"), F.count_if(F.col(step) > last_train).alias("b")).first()
    if not n["a"] or not n["b"]:
        raise ValueError(f"a split after step {last_train} leaves a side empty")
    return known.where(F.col(step) <= last_train), known.where(F.col(step) > last_train)


def audit(train: DataFrame, test: DataFrame, features: Iterable[str], step: str = "time_step", target: str = "target") -> DataFrame:
    """(check, passed): steps shared by both sides, their order, forbidden features, targets beyond 0 and 1, null targets."""
    steps = lambda df: df.select(step).distinct()  # noqa: E731  some 49 rows
    shared = steps(train).join(steps(test), step).agg(F.count(F.lit(1)).alias("shared"))
    ends = train.agg(F.max(step).alias("last"), F.count_if(~F.col(target).isin(0, 1)).alias("odd"), F.count_if(F.col(target).isNull()).alias("null"))
    first = test.agg(F.min(step).alias("first"))
    leaked = sorted(set(features) & FORBIDDEN)
    one = shared.join(F.broadcast(ends)).join(F.broadcast(first))  # one row each
    checks = {
        "no_shared_steps": F.col("shared") == 0, "steps_in_order": F.coalesce(F.col("last") < F.col("first"), F.lit(False)), "no_forbidden_features": F.lit(not leaked),
        "binary_target": F.col("odd") == 0, "no_null_target": F.col("null") == 0,
    }
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])).alias("c")).select("c.*")


def medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """Median of each feature among the training rows; 0 where there is none."""
    row = train.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), 0.5, 10_000).alias(f"m{i}") for i, c in enumerate(features)]).first()
    return {c: float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(features)}


def values(rows: DataFrame, features: list[str], fill: dict[str, float]) -> list[Column]:
    """The features, with missing ones, and those that aren't columns at all, set to the training medians."""
    have = set(rows.columns)
    return [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(fill[c])) if c in have else F.lit(fill[c]) for c in features]


def filled(rows: DataFrame, features: list[str], fill: dict[str, float]) -> DataFrame:
    """``rows`` with ``values`` as the vector __x."""
    return rows.withColumn("__x", array_to_vector(F.array(*values(rows, features, fill))))


@dataclass
class Classifier:
    """A forest with the features, medians and name that it was trained with."""

    forest: forest.Forest
    features: list[str]
    fill: dict[str, float]
    feature_set: str

    @cached_property
    def model(self) -> PipelineModel:
        return PipelineModel([self.forest.mllib(SparkSession.active())])

    def probability(self, rows: DataFrame) -> Column:
        """That a row of ``rows`` is illicit."""
        return self.forest.probability(values(rows, self.features, self.fill))

    @property
    def about(self) -> dict:
        return {"feature_names": self.features, "feature_medians": self.fill, "feature_set": self.feature_set}

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with prediction (0 or 1) and probability (that the row is illicit)."""
        out = rows.withColumn("__p", self.probability(rows)).drop("prediction", "probability")
        return out.withColumn("prediction", (F.col("__p") > 0.5).cast("int")).withColumnRenamed("__p", "probability")

    def importances(self, prefix: str | None = None) -> list[tuple[str, float]]:
        return ml.importances(self.model.stages[-1], self.features, prefix)


def train(rows: DataFrame, features: list[str], feature_set: str = "M1", trees: int = 200, seed: int = 42, target: str = "target") -> Classifier:
    """A balanced forest on (features, target); no rows, or forbidden features, raise ValueError."""
    leaked = sorted(set(features) & FORBIDDEN)
    if leaked:
        raise ValueError(f"forbidden features: {leaked}")
    if not rows.take(1):
        raise ValueError("no training rows")
    y, at = F.col(target).cast("double"), [k / 256 for k in range(1, 256)]
    quantiles = [F.percentile_approx(F.col(f"`{c}`").cast("double"), F.array(*map(F.lit, at)), 10_000).alias(f"m{i}") for i, c in enumerate(features)]
    row = rows.agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"), *quantiles).first()
    fill = {c: float(row[f"m{i}"][127]) if row[f"m{i}"] else 0.0 for i, c in enumerate(features)}  # the median
    cuts = [forest.cut_points(row[f"m{i}"]) for i in range(len(features))]
    grown = forest.grow(rows, values(rows, features, fill), y, cuts, (row["n0"], row["n1"]), trees, seed=seed, column="__x")
    return Classifier(grown, list(features), fill, feature_set)


def evaluate(scored: DataFrame, target: str = "target") -> DataFrame:
    """One row: counts, accuracy, precision, recall, f1 of (target, prediction, probability), and roc_auc; null with one class only."""
    rows = scored.select(F.col(target).alias("y"), F.col("prediction").alias("predicted"), F.col("probability").alias("score"))
    rows = stash(rows, "evaluated")
    return metrics.confusion(rows).join(F.broadcast(metrics.ap_auc(rows).select("roc_auc")))  # one row each


def infer(classifier: Classifier, rows: DataFrame, id_col: str, version: str, anomaly: DataFrame | None = None, synthetic: bool = False) -> DataFrame:
    """(entity_id, prediction, probability of the predicted class, anomaly_score, model_version, feature_set, contains_synthetic_input) of
    rows that may lack features, which get the training medians."""
    out = classifier.score(rows).withColumn("__id", F.col(id_col).cast("string"))
    p = F.when(F.col("prediction") == 1, F.col("probability")).otherwise(1 - F.col("probability"))
    score = F.lit(None).cast("double")
    if anomaly is not None:
        out = out.join(anomaly.select(F.col("id").cast("string").alias("__id"), F.col("anomaly").alias("__anomaly")), "__id", "left")
        score = F.col("__anomaly")
    return out.select(
        F.col("__id").alias("entity_id"), "prediction", p.alias("probability"), score.alias("anomaly_score"), F.lit(version).alias("model_version"), F.lit(classifier.feature_set).alias("feature_set"), F.lit(synthetic).alias("contains_synthetic_input")
    )


def anomaly_scores(train_rows: DataFrame, rows: DataFrame, features: list[str], id_col: str, fill: dict[str, float], trees: int = 200) -> DataFrame:
    """(id, anomaly): isolation scores of ``rows`` by trees grown on the training rows, scaled to [0, 1] over the rows."""
    x = lambda df: filled(df, features, fill).select(F.col(id_col).alias("id"), vector_to_array("__x").alias("x"))
    found = stash(ml.isolation_transform(x(train_rows), x(rows), trees), "anomaly")
    return ml.min_max(found.withColumnRenamed("score", "anomaly"), "anomaly")


def rules(rows: DataFrame) -> Column:
    """Share of five plain rules that fire: fan-out, fan-in, one dominant of two outputs, a busy junction, a large amount. A missing
    column never fires."""
    have = set(rows.columns)
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)
    n_out = c("num_output_addresses")
    dominant = F.coalesce(F.try_divide(c("out_BTC_max"), c("out_BTC_total")), F.lit(0.0)) > 0.9
    return ml.rule_score(n_out >= 10, c("num_input_addresses") >= 10, (n_out == 2) & dominant, (c("in_txs_degree") >= 5) & (c("out_txs_degree") >= 5), c("total_BTC") >= 100)


def fused(probability: Column, anomaly: Column, graph: Column | None = None) -> DataFrame:
    """0 to 100: the risk synthesis of a transaction's model probability, anomaly and, if given, rules as the structural signal."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    none = F.lit(None).cast("double")
    signals = F.struct(clip(probability).alias("ml"), clip(anomaly).alias("anomaly"), (none if graph is None else clip(graph)).alias("graph"), none.alias("correlation"), none.alias("known"))
    return signals


def fused_score(rows: DataFrame, name: str, probability: Column, anomaly: Column, graph: Column | None = None) -> DataFrame:
    """``rows`` with the fused score as ``name``."""
    keep = rows.columns
    signals = fused(probability, anomaly, graph)
    wide = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__own"), signals.alias("__s")).select("__own", "__s.*")
    return wide.withColumn("__score", risk.score_column()).select("__own.*", F.col("__score").alias(name))


DETECTORS = ("random", "rules_only", "logistic_regression", "anomaly_only", "ml_only_rf", "fused_rf_anomaly", "fused_rf_anomaly_rules")


@dataclass
class Detectors:
    """All detectors fitted on one training window."""

    rf: Classifier
    logistic: PipelineModel
    train_rows: DataFrame
    trees: int

    def score_all(self, rows: DataFrame, id_col: str) -> DataFrame:
        """(id, target, one score column for each of DETECTORS)."""
        f = self.rf
        base = filled(rows, f.features, f.fill).withColumn("ml_only_rf", f.probability(rows)).withColumn("rules_only", rules(rows))
        scored = self.logistic.transform(base.select(F.col(id_col).alias("id"), "target", "rules_only", "__x", "ml_only_rf"))
        scored = scored.select("id", "target", "rules_only", "ml_only_rf", vector_to_array("lr_probability")[1].alias("logistic_regression"))
        odd = anomaly_scores(self.train_rows, rows, f.features, id_col, f.fill, self.trees).select("id", F.col("anomaly").alias("anomaly_only"))
        out = stash(scored.join(odd, "id").withColumn("random", F.pmod(F.xxhash64("id", F.lit(42)), F.lit(1_000_003)) / 1_000_003), "scores")
        out = fused_score(out, "fused_rf_anomaly", F.col("ml_only_rf"), F.col("anomaly_only"))
        out = fused_score(out, "fused_rf_anomaly_rules", F.col("ml_only_rf"), F.col("anomaly_only"), F.col("rules_only"))
        return out.select("id", "target", *DETECTORS)


def fit_detectors(train_rows: DataFrame, features: list[str], trees: int = 200, seed: int = 42, isolation_trees: int = 200) -> Detectors:
    rf = train(train_rows, features, "benchmark", trees, seed)
    data = filled(train_rows, features, rf.fill).select("__x", F.col("target").cast("double").alias("label"))
    scale = StandardScaler(inputCol="__x", outputCol="__s", withMean=True)
    lr = LogisticRegression(featuresCol="__s", labelCol="label", weightCol="weight", probabilityCol="lr_probability", rawPredictionCol="lr_raw", predictionCol="lr_prediction", maxIter=100)
    return Detectors(rf, Pipeline(stages=[scale, lr]).fit(ml.balanced(stash(data, "train"))), train_rows, isolation_trees)


def bundle(rows: DataFrame, score: str, ks: tuple[int, ...] = KS, tie: str = "id", target: str = "target", replicates: int = 0) -> DataFrame:
    """One row of ranking metrics of a score: n, positives, base_rate, pr_auc, roc_auc, precision, recall and lift at each k, the best F1
    and, with ``replicates``, a bootstrap interval of precision at 100."""
    r = stash(rows.select(F.col(tie).alias("id"), F.col(target).cast("long").alias("y"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score")), "ranked")
    out = r.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_positive")).withColumn("base_rate", F.col("n_positive") / F.col("n"))
    out = out.join(F.broadcast(metrics.ap_auc(r).withColumnRenamed("average_precision", "pr_auc")))  # one row each, here and below
    for k in ks:
        at = metrics.at_k(r, k, "id").select(F.col("precision").alias(f"precision_at_{k}"), F.col("recall").alias(f"recall_at_{k}"), F.col("lift").alias(f"lift_at_{k}"))
        out = out.join(F.broadcast(at))
    best = metrics.best_f1(r).select(F.col("f1").alias("best_f1"), F.col("precision").alias("best_f1_precision"), F.col("recall").alias("best_f1_recall"), F.col("score").alias("best_f1_threshold"))
    out = out.join(F.broadcast(best))
    if replicates:
        top = r.orderBy(F.desc("score"), "id").limit(100).select("id", "y", F.lit(1).alias("predicted"))
        out = out.join(F.broadcast(metrics.bootstrap_precision(top, replicates).select(F.col("low").alias("precision_at_100_low"), F.col("high").alias("precision_at_100_high"))))
    return out


def compare(train_rows: DataFrame, test_rows: DataFrame, features: list[str], id_col: str, trees: int = 200, ks: tuple[int, ...] = KS, isolation_trees: int = 200, replicates: int = 0) -> DataFrame:
    """(detector, metrics…): every detector on one split."""
    scores = stash(fit_detectors(train_rows, features, trees, isolation_trees=isolation_trees).score_all(test_rows, id_col), "scored")
    out = None
    for name in DETECTORS:
        row = bundle(scores, name, ks, replicates=replicates).select(F.lit(name).alias("detector"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def rolling_origin(rows: DataFrame, features: list[str], id_col: str, cutoffs: tuple[int, ...] = (20, 25, 30, 34, 39, 44), window: int = 5, step: str = "time_step", trees: int = 100) -> DataFrame:
    """(cutoff, n_test, n_positive, base_rate, ml_pr_auc, ml_precision_at_100, rules_pr_auc): trained up to each cutoff, tested on the
    ``window`` steps after it. Origins without both classes on both sides are left out."""
    sides = lambda c: (F.col(step) <= c, (F.col(step) > c) & (F.col(step) <= c + window))
    ends = [f(F.when(on, F.col("target"))).alias(f"{k}{i}_{c}") for c in cutoffs for i, on in enumerate(sides(c)) for k, f in (("a", F.min), ("b", F.max))]
    ends = rows.agg(F.count(F.lit(1)), *ends).first()  # all origins in one pass
    out = []
    for cutoff in cutoffs:
        if any(ends[f"a{i}_{cutoff}"] == ends[f"b{i}_{cutoff}"] for i in (0, 1)):  # one class, or nulls of no rows
            continue
        before, after = map(rows.where, sides(cutoff))
        rf = train(before, features, "rolling", trees)
        scored = stash(rf.score(after).withColumn("rules", rules(after)).select(F.col(id_col).alias("id"), "target", "probability", "rules"), "rolled")
        ranked = lambda c: scored.select("id", F.col("target").cast("long").alias("y"), F.col(c).cast("double").alias("score"))  # noqa: E731, B023
        n, y = scored.agg(F.count(F.lit(1)), F.sum("target")).first()
        ml_ap, rules_ap = (metrics.ap_auc(ranked(c)).first()["average_precision"] for c in ("probability", "rules"))
        out.append((cutoff, n, y, y / n, ml_ap, metrics.at_k(ranked("probability"), 100, "id").first()["precision"], rules_ap))
        release(scored)
    return rows.sparkSession.createDataFrame(out, "cutoff int, n_test bigint, n_positive bigint, base_rate double, ml_pr_auc double, ml_precision_at_100 double, rules_pr_auc double")


def spread(train_rows: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation of each feature."""
    row = train_rows.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, c in enumerate(features)}


def perturbed(rows: DataFrame, features: list[str], of: dict[str, tuple[float, float]], id_col: str, noise: float = 0.0, dropout: float = 0.0, seed: int = 42) -> DataFrame:
    """``rows`` with normal noise of ``noise`` standard deviations on each feature, or a share of cells at the mean. Draws come from
    hashes of row and feature, so a rerun perturbs alike."""
    u = lambda c, k: (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.lit(c), F.lit(k)), F.lit(1 << 30)) + 0.5) / (1 << 30)

    def cell(c: str) -> Column:
        mean, sd = of[c]
        x = F.col(f"`{c}`").cast("double")
        if noise:
            x = x + F.sqrt(-2 * F.log(u(c, 0))) * F.cos(2 * 3.141592653589793 * u(c, 1)) * float(noise * sd)
        return F.when(u(c, 2) < dropout, float(mean)).otherwise(x) if dropout else x

    return rows.withColumns({c: cell(c) for c in features})


def robustness(d: Detectors, test_rows: DataFrame, id_col: str, noises: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 1.0), dropouts: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5)) -> DataFrame:
    """(perturbation, level, ml_pr_auc, fused_pr_auc, anomaly_pr_auc) as the test features get worse; nothing is trained again."""
    of, out = spread(d.train_rows, d.rf.features), []
    for kind, levels in (("noise", noises), ("dropout", dropouts)):
        for level in levels:
            rows = perturbed(test_rows, d.rf.features, of, id_col, **{kind: level})
            s = stash(d.score_all(rows, id_col), "perturbed")
            out.append((kind, float(level), *(bundle(s, c, ()).first()["pr_auc"] for c in ("ml_only_rf", "fused_rf_anomaly", "anomaly_only"))))
    return test_rows.sparkSession.createDataFrame(out, "perturbation string, level double, ml_pr_auc double, fused_pr_auc double, anomaly_pr_auc double")


def progression(train_rows: DataFrame, test_rows: DataFrame, trees: int = 200, sets: tuple[str, ...] = ("M1", "M2", "M3")) -> DataFrame:
    """(feature_set, n_features, accuracy, precision, recall, f1, roc_auc) of a classifier for each feature set. Sets that are alike among
    the columns there are share one: rows, features and seed are the same, so its figures are too."""
    out, known = None, {}
    for name in sets:
        features = features_of(name, train_rows.columns)
        if tuple(features) not in known:
            scored = train(train_rows, features, name, trees).score(test_rows)
            known[tuple(features)] = stash(evaluate(scored).select(F.lit(len(features)).alias("n_features"), "accuracy", "precision", "recall", "f1", "roc_auc"), "figures")
        row = known[tuple(features)].select(F.lit(name).alias("feature_set"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def step_summary(scored: DataFrame, step: str = "time_step") -> DataFrame:
    """(summary): a map of each step to its n, accuracy, precision, recall and f1, of (step, y, predicted)."""
    per = metrics.confusion(scored.withColumnRenamed(step, "step"), ["step"])
    value = F.struct((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), "accuracy", "precision", "recall", "f1")
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("step").cast("int").alias("key"), value.alias("value"))))).alias("summary"))  # a row for each of 49 steps
