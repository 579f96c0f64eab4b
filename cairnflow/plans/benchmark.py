"""How well leads rank: per signal, by feature family, against plain baselines, with seeds, on unseen scenarios, on worse data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.config import FORENSIC, ForensicsConfig, GraphConfig
from cairnflow.durable import stash
from cairnflow.functions.scalars import noisy_or, seed_boost, signed_log, temporal_burst
from cairnflow.operators import detect, entities, graph, ml, risk
from cairnflow.plans import forensics

KS = (10, 25, 50, 100)
SIGNALS = {"fused_score": "score", "fused_without_seed_boost": "score_base", "model_probability": "ml", "structural_heuristics_only": "graph", "anomaly_only": "anomaly", "seed_propagation_only": "seed_risk"}


def ranking(rows: DataFrame, scores: dict[str, str], ks: tuple[int, ...] = KS, replicates: int = 0) -> DataFrame:
    """(signal, metrics…) of (entity, y, score columns), a row for each named column."""
    rows, out = stash(rows, "ranking"), None
    for name, column in scores.items():
        one = detect.bundle(rows, column, ks, "entity", "y", replicates).select(F.lit(name).alias("signal"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def signal_quality(leads: DataFrame, truth: DataFrame, known: DataFrame | None = None, ks: tuple[int, ...] = KS) -> DataFrame:
    """The ranking of each signal of leads against (entity, is_illicit). Seeds, and ``known`` entities, are left out: they were told."""
    rows = leads.where(~F.col("is_seed")).join(truth.select("entity", F.col("is_illicit").cast("int").alias("y")).where("y is not null"), "entity")
    if known is not None:
        rows = rows.join(known.select("entity"), "entity", "left_anti")
    return ranking(rows.select("entity", "y", *SIGNALS.values()), SIGNALS, ks)


def seed_enrichment(near: DataFrame) -> DataFrame:
    """(n_seeds, n_within_2, illicit_share_within_2, illicit_share, illicit_found_within_2) of (entity, y, is_seed, seed_hops)."""
    close = F.col("seed_hops").between(1, 2)
    rest, share = ~F.col("is_seed"), lambda c: F.avg(F.when(c, F.col("y").cast("double")))
    return near.agg(
        F.count_if("is_seed").alias("n_seeds"), F.count_if(rest & close).alias("n_within_2"), share(rest & close).alias("illicit_share_within_2"), share(rest).alias("illicit_share"),
        F.avg(F.when(rest & (F.col("y") == 1), F.coalesce(close, F.lit(False)).cast("double"))).alias("illicit_found_within_2"),
    )


class Benchmark:
    """Experiments on one set of features (entity, …) with truth (entity, is_illicit, scenario, campaign). Everything is scored out of
    fold, with whole campaigns in one fold."""

    def __init__(self, features: DataFrame, truth: DataFrame, families: dict[str, list[str]], f: ForensicsConfig = ForensicsConfig(), ks: tuple[int, ...] = KS):
        self.families, self.f, self.ks = families, f, ks
        y = truth.where(F.col("is_illicit").isNotNull()).select("entity", F.col("is_illicit").cast("int").alias("y"), "scenario", "campaign")
        self.rows = stash(ml.assign_folds(features.join(y, "entity"), f.folds), "bench")
        self.oof: dict[str, DataFrame] = {}

    def probabilities(self, name: str, columns: list[str], rows: DataFrame | None = None) -> DataFrame:
        """(entity, name): out-of-fold probabilities of a forest on these columns; 0 for a fold that couldn't be trained."""
        rows = self.rows if rows is None else rows
        x = forensics.assembled(rows, columns).join(rows.select(F.col("entity").alias("id"), F.col("y").cast("double").alias("label"), "fold"), "id")
        p = ml.out_of_fold(x, self.f.trees, self.f.max_negatives)
        return stash(p.select(F.col("id").alias("entity"), F.coalesce("calibrated", F.lit(0.0)).alias(name)), "oof")

    def ablation(self) -> DataFrame:
        """Ranking with one family of features more each time."""
        steps, columns = {}, []
        for name in ("behavioural", "network", "heuristics", "graph", "embeddings"):
            if self.families.get(name):
                columns = columns + self.families[name]
                steps["behavioural_only" if name == "behavioural" else f"+{name}"] = columns
        rows = self.rows.select("entity", "y")
        for name, cols in steps.items():
            self.oof[name] = self.probabilities(name, cols)
            rows = rows.join(self.oof[name], "entity")
        return ranking(rows, {n: n for n in steps}, self.ks)

    def scores(self) -> DataFrame:
        """(entity, y, scenario, random, rules_only, anomaly_only, logistic_regression, rf_full, fused)."""
        plain = [c for k in ("behavioural", "network", "heuristics", "graph") for c in self.families.get(k, [])]
        full = plain + self.families.get("embeddings", [])
        x = self.rows
        z = lambda c: F.col(c) if c in x.columns else F.lit(0.0)
        heur = risk.structural(x) if {"peel_chain_txs", "max_peel_chain_len"} <= set(x.columns) else noisy_or(F.lit(0.0))
        burst = temporal_burst(z("peak_events"), z("n_events"), z("burstiness"))
        base = x.select("entity", "y", "scenario", "fold", heur.alias("rules_only"), z("network_obfuscation").alias("network"), burst.alias("burst"), (F.pmod(F.xxhash64("entity", F.lit(self.f.seed)), F.lit(1_000_003)) / 1_000_003).alias("random"))
        odd, lr = None, None
        cols = self.families["behavioural"] + self.families.get("network", [])
        arr = lambda df, cs: df.select(F.col("entity").alias("id"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cs]).alias("x"))
        logs = x.select("entity", "y", "fold", *[signed_log(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in plain])
        for k in range(self.f.folds):
            train, test = x.where(F.col("fold") != k), x.where(F.col("fold") == k)
            if not test.take(1) or train.where("y = 1").limit(2).count() < 2:
                continue
            a = ml.isolation_transform(arr(train, cols), arr(test, cols))
            odd = a if odd is None else odd.unionByName(a)
            model = ml.logistic(forensics.assembled(logs.where(F.col("fold") != k), plain).join(train.select(F.col("entity").alias("id"), F.col("y").cast("double").alias("label")), "id"))
            b = ml.probability(model, forensics.assembled(logs.where(F.col("fold") == k), plain))
            lr = b if lr is None else lr.unionByName(b)
        rf = self.probabilities("rf_full", full)
        out = base.join(rf, "entity")
        none = x.select("entity").limit(0)
        out = out.join(none.withColumn("anomaly_only", F.lit(0.0)) if odd is None else odd.select(F.col("id").alias("entity"), F.col("score").alias("anomaly_only")), "entity", "left")
        out = out.join(none.withColumn("logistic_regression", F.lit(0.0)) if lr is None else lr.select(F.col("id").alias("entity"), F.col("p").alias("logistic_regression")), "entity", "left")
        return stash(self.fused(out.fillna(0.0), "rf_full"), "baselines")

    @staticmethod
    def fused(rows: DataFrame, probability: str) -> DataFrame:
        """``rows`` with fused, the forensic fusion of a probability column with anomaly_only, rules_only, network and burst."""
        keep = rows.columns
        custom = F.create_map(F.lit("network_obfuscation"), F.col("network"), F.lit("temporal_burst"), F.col("burst"))
        none = F.lit(None).cast("double")
        wide = rows.withColumns({"ml": F.col(probability), "anomaly": F.col("anomaly_only"), "graph": F.col("rules_only"), "correlation": none, "known": none})
        return risk.fuse(wide, "weighted", FORENSIC, custom).select(*keep, F.col("score").alias("fused"))

    def baselines(self) -> DataFrame:
        names = ("random", "rules_only", "anomaly_only", "logistic_regression", "rf_full", "fused")
        return ranking(self.scores(), {n: n for n in names}, self.ks)

    def seed_reveal(self, flows: DataFrame, hubs: DataFrame, fractions: tuple[float, ...] = (0.05, 0.10, 0.20), g: GraphConfig = GraphConfig()) -> DataFrame:
        """(fraction, signal, metrics…) of the entities that aren't seeds, when a share of the illicit ones is known: seed risk alone,
        the fused score, and the fused score raised near seeds."""
        scores, out = self.scores(), None
        positives = stash(scores.where("y = 1").select("entity"), "positives")
        n = positives.count()
        for fraction in fractions:
            seeds = positives.orderBy(F.xxhash64("entity", F.lit(int(fraction * 1000))), "entity").limit(max(2, int(n * fraction)))
            near = graph.seed_risk(flows, seeds.select(F.col("entity").alias("node")), hubs, g)
            rows = scores.join(near.select(F.col("node").alias("entity"), "risk", "is_seed"), "entity", "left").fillna({"risk": 0.0, "is_seed": False}).where("not is_seed")
            rows = rows.withColumn("boosted", F.round(seed_boost(F.col("fused"), F.col("risk"), FORENSIC.seed_weight), 2))
            one = ranking(rows, {"seed_propagation_only": "risk", "fused_without_seeds": "fused", "fused_with_seed_boost": "boosted"}, self.ks).select(F.lit(fraction).alias("fraction"), "*")
            out = one if out is None else out.unionByName(one)
        return out

    def leave_one_out(self, least: int = 4) -> DataFrame:
        """(scenario, signal, metrics…): trained without a scenario and three tenths of the ordinary entities, tested on them."""
        plain = [c for k in ("behavioural", "network", "heuristics", "graph") for c in self.families.get(k, [])]
        full, behaviour = plain + self.families.get("embeddings", []), self.families["behavioural"] + self.families.get("network", [])
        scores, out = self.scores(), None
        apart = F.pmod(F.xxhash64("entity", F.lit(self.f.seed + 5)), F.lit(10)) < 3
        names = [r["scenario"] for r in self.rows.where("scenario <> 'normal'").groupBy("scenario").count().where(F.col("count") >= least).orderBy("scenario").collect()]  # a handful of scenarios
        for s in names:
            test = self.rows.where((F.col("scenario") == s) | ((F.col("scenario") == "normal") & apart))
            train = self.rows.where((F.col("scenario") != s) & ~((F.col("scenario") == "normal") & apart))
            rows = scores.join(test.select("entity"), "entity", "left_semi")
            for name, cols in (("rf_unseen", full), ("rf_behavioural", behaviour)):
                data = forensics.assembled(train, cols).join(train.select(F.col("entity").alias("id"), F.col("y").cast("double").alias("label")), "id")
                if data.where("label = 1").limit(2).count() < 2:
                    rows = rows.withColumn(name, F.lit(0.0))
                    continue
                p = ml.probability(ml.forest(ml.negatives_capped(stash(data, "train"), self.f.max_negatives), self.f.trees), forensics.assembled(test, cols))
                rows = rows.join(p.select(F.col("id").alias("entity"), F.col("p").alias(name)), "entity")
            rows = self.fused(rows.drop("fused"), "rf_unseen")
            one = ranking(rows, {n: n for n in ("rules_only", "rf_behavioural", "rf_unseen", "fused")}, (10,)).select(F.lit(s).alias("scenario"), "*")
            out = one if out is None else out.unionByName(one)
        return out

    def robustness(self, noises: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0), dropouts: tuple[float, ...] = (0.0, 0.25, 0.5)) -> DataFrame:
        """(perturbation, level, pr_auc, precision_at_25) of forests trained on clean folds and tested on worse features."""
        plain = [c for k in ("behavioural", "network", "heuristics", "graph") for c in self.families.get(k, [])]
        full, worse = plain + self.families.get("embeddings", []), self.families["behavioural"] + self.families.get("network", [])
        models = {}
        for k in range(self.f.folds):
            train = self.rows.where(F.col("fold") != k)
            data = forensics.assembled(train, full).join(train.select(F.col("entity").alias("id"), F.col("y").cast("double").alias("label")), "id")
            if data.where("label = 1").limit(2).count() == 2:
                models[k] = ml.forest(ml.negatives_capped(stash(data, "train"), self.f.max_negatives), self.f.trees)
        of, out = detect.spread(self.rows, worse), []
        for kind, levels in (("noise", noises), ("dropout", dropouts)):
            for level in levels:
                bad, p = detect.perturbed(self.rows, worse, of, "entity", **{kind: level}), None
                for k, model in models.items():
                    one = ml.probability(model, forensics.assembled(bad.where(F.col("fold") == k), full))
                    p = one if p is None else p.unionByName(one)
                if p is None:
                    continue
                m = detect.bundle(self.rows.select("entity", "y").join(p.withColumnRenamed("id", "entity"), "entity"), "p", (25,), "entity", "y").first()
                out.append((kind, float(level), m["pr_auc"], m["precision_at_25"]))
        return self.rows.sparkSession.createDataFrame(out, "perturbation string, level double, pr_auc double, precision_at_25 double")


def run(p: forensics.Prepared, truth: DataFrame, f: ForensicsConfig = ForensicsConfig(), g: GraphConfig = GraphConfig()) -> dict[str, DataFrame]:
    """All experiments on a prepared dataset with (addr, illicit, scenario, campaign)."""
    known = forensics.entity_truth(p, truth)
    b = Benchmark(p.features.where(F.col("n_events") >= g.min_events), known, forensics.families(p.features.columns), f)
    own = truth.select("addr", "owner") if "owner" in truth.columns else None
    out = {"ablation": b.ablation(), "baselines": b.baselines(), "seed_reveal": b.seed_reveal(p.flows, p.hubs, g=g), "leave_one_out": b.leave_one_out(), "robustness": b.robustness()}
    return out if own is None else out | {"clustering": entities.clustering_quality(p.members, own)}
