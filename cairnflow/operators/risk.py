"""Risk synthesis, rollups, rankings and alert queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.config import GraphConfig, RiskConfig
from cairnflow.functions.scalars import bind, noisy_or, seed_boost, tier, tier_rank

C = RiskConfig()
SIGNALS = ("ml", "anomaly", "graph", "correlation", "known")


def weighted_mean(c: RiskConfig = C, custom: Column | None = None) -> Column:
    """Weighted mean of the signals that are there, 0 without any. ``custom`` is a map of further signals, clamped to [0, 1]; each
    weighs what ``custom_weights`` says of its name, else ``custom_weight``."""
    total = sum((F.when(F.col(s).isNotNull(), F.col(s) * c.weights[s]).otherwise(0.0) for s in SIGNALS), F.lit(0.0))
    weight = sum((F.when(F.col(s).isNotNull(), F.lit(c.weights[s])).otherwise(0.0) for s in SIGNALS), F.lit(0.0))
    if custom is not None:
        weigh = lambda k: F.lit(c.custom_weight)
        if c.custom_weights:
            known = F.create_map(*[F.lit(x) for kv in c.custom_weights.items() for x in kv])
            weigh = lambda k: F.coalesce(F.element_at(known, k), F.lit(c.custom_weight))
        values = F.filter(F.map_entries(custom), lambda e: e["value"].isNotNull())
        total = total + F.coalesce(F.aggregate(values, F.lit(0.0), lambda s, e: s + weigh(e["key"]) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["value"]))), F.lit(0.0))
        weight = weight + F.coalesce(F.aggregate(values, F.lit(0.0), lambda s, e: s + weigh(e["key"])), F.lit(0.0))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def corroborated() -> Column:
    z = lambda s: F.coalesce(s, F.lit(0.0))
    return (z("ml") >= 0.6) & ((z("graph") >= 0.5) | (z("anomaly") >= 0.6) | (z("known") >= 0.5))


def lone_anomaly() -> Column:
    z = lambda s: F.coalesce(s, F.lit(0.0))
    return (z("anomaly") >= 0.6) & (z("ml") < 0.4) & (z("graph") < 0.4) & (z("known") < 0.4)


def score_column(policy: str = "weighted", c: RiskConfig = C, custom: Column | None = None) -> Column:
    """0 to 100, two decimals. Policies: 'weighted' (boost for corroborated signals, cap for a lone anomaly), 'max' (largest signal,
    boosted when two or more are strong), 'plain' (the mean alone)."""
    if policy == "max":
        present = F.filter(F.array(*[F.col(s) for s in SIGNALS]), lambda v: v.isNotNull())
        strong = F.size(F.filter(present, lambda v: v >= 0.5))
        top = F.coalesce(F.array_max(present), F.lit(0.0)) * 100
        raw = F.when(strong >= 2, top * c.policy_boost).otherwise(top)
    else:
        raw = weighted_mean(c, custom) * 100
        if policy == "weighted":
            raw = bind(raw, lambda x: F.when(corroborated(), F.least(F.lit(100.0), x * c.boost)).when(lone_anomaly(), F.least(x, F.lit(c.lone_anomaly_cap))).otherwise(x))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 2)


def fuse(rows: DataFrame, policy: str = "weighted", c: RiskConfig = C, custom: Column | None = None) -> DataFrame:
    """``rows`` with score, tier, and is_synthetic (a correlation signal takes part). ``custom`` is a map of further signals."""
    out = rows.withColumn("score", score_column(policy, c, custom))
    return out.withColumn("tier", bind(F.col("score"), lambda x: tier(x, c))).withColumn("is_synthetic", F.col("correlation").isNotNull())


def boosted(rows: DataFrame, c: RiskConfig = C) -> DataFrame:
    """(… seed_risk, is_seed) with score raised by proximity to seeds; seeds are not raised."""
    up = F.round(seed_boost(F.col("score"), F.coalesce("seed_risk", F.lit(0.0)), c.seed_weight), 2)
    out = rows.withColumn("score_base", F.col("score")).withColumn("score", F.when(F.col("is_seed"), F.col("score")).otherwise(up))
    return out.withColumn("tier", tier(F.col("score"), c))


def rollup(rows: DataFrame, by: str, tx: str = "entity", score: str = "score", volume: str = "volume", flag_at: float = C.flag_at) -> DataFrame:
    """Per group: largest score and its transaction, mean, volume-weighted mean, share of flagged, and counts."""
    v = F.coalesce(volume, F.lit(1.0))
    flagged = F.col(score) >= flag_at
    out = rows.groupBy(by).agg(
        F.max(score).alias("max_score"), F.min_by(tx, F.struct(-F.col(score), F.col(tx))).alias("max_tx"), F.avg(score).alias("mean_score"),
        F.coalesce(F.sum(F.col(score) * v) / F.nullif(F.sum(v), F.lit(0.0)), F.lit(0.0)).alias("weighted_score"), (100 * F.avg(flagged.cast("double"))).alias("frequency_score"), F.count_if(flagged).alias("n_flagged"), F.bool_or("is_synthetic").alias("is_synthetic"),
    )
    return out.withColumn("tier", tier(F.round("max_score", 2)))


def contributions(rows: DataFrame, by: str, tx: str = "entity", score: str = "score", top: int = 5) -> DataFrame:
    """(by, contributions): the ``top`` scores of each group, largest first, as 'tx:score' joined by commas."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tx))
    best = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    item = F.struct("rn", F.concat_ws(":", F.col(tx).cast("string"), F.format_string("%.2f", F.col(score))).alias("t"))
    return best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ",").alias("contributions"))


def dashboard(alerts: DataFrame) -> DataFrame:
    """(kind, value, n): counts by tier and by status; dismissed also counts as closed."""
    tiers = alerts.groupBy(F.lit("tier").alias("kind"), F.col("tier").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    status = alerts.groupBy(F.lit("status").alias("kind"), F.col("status").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    closed = alerts.where(F.col("status").isin("dismissed", "closed")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("closed").alias("kind"), F.lit("all").alias("value"), "n")
    return tiers.unionByName(status).unionByName(closed)


def rank_leads(rows: DataFrame) -> DataFrame:
    """Rank from 1 by score, ties by entity, among rows above 0 that aren't seeds. The others have rank 0.

    Ranks come from counts by score: rows of equal score are numbered together, and the table of distinct scores (two decimals, so
    10,001 at most) carries the offsets."""
    ok = (F.col("score") > 0) & ~F.col("is_seed")
    live = rows.where(ok)
    steps = live.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("score").orderBy("entity"))
    ranked = live.join(F.broadcast(steps), "score").withColumn("rank", (F.col("before") + at).cast("long")).drop("before")
    return ranked.unionByName(rows.where(~ok).withColumn("rank", F.lit(0).cast("long")))


def rank_entities(rows: DataFrame, min_score: float = 0.0, min_tier: str | None = None, limit: int = 100) -> DataFrame:
    """Score, then corroboration count, then entity; tiers only filter."""
    out = rows.where(F.col("score") >= min_score)
    if min_tier:
        out = out.where(tier_rank(F.col("tier")) >= tier_rank(F.lit(min_tier)))
    return out.orderBy(F.desc("score"), F.desc("corroboration"), F.asc("entity")).limit(limit)


def filter_alerts(alerts: DataFrame, min_tier: str | None = None, status: str | None = None, include_synthetic: bool = True, min_score: float = 0.0) -> DataFrame:
    out = alerts.where(F.col("score") >= min_score)
    if min_tier:
        out = out.where(tier_rank(F.col("tier")) >= tier_rank(F.lit(min_tier)))
    if status:
        out = out.where(F.col("status") == ("dismissed" if status == "closed" else status))
    return out if include_synthetic else out.where(~F.col("is_synthetic"))


def triage(alerts: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Most severe tier, then score, then oldest."""
    return alerts.orderBy(F.desc(tier_rank(F.col("tier"))), F.desc("score"), F.asc("created_at"), F.asc("entity")).offset(offset).limit(limit)


def search(alerts: DataFrame, text: str, tx_entities: DataFrame, addr_entities: DataFrame) -> DataFrame:
    """Alerts of an entity number (E- allowed), of a transaction prefix of 8 letters or more, or of part of an address."""
    text = text.strip().lower()
    bare = text.removeprefix("e-")
    if bare.isdigit():
        return alerts.where(F.col("entity") == int(bare))
    found = addr_entities.where(F.lower("addr").contains(text)).select("entity")
    if len(text) >= 8:
        found = found.unionByName(tx_entities.where(F.lower("txid").startswith(text)).select("entity"))
    return alerts.join(found.distinct(), "entity", "left_semi")


def hubs(degree: DataFrame, sizes: DataFrame, c: GraphConfig = GraphConfig()) -> DataFrame:
    """(entity): many payers and payees, or many addresses."""
    rows = degree.join(sizes, "entity", "full_outer").fillna(0)
    return rows.where(((F.col("in_degree") >= c.hub_in) & (F.col("out_degree") >= c.hub_out)) | (F.col("n_addresses") >= c.hub_addresses)).select("entity")


def candidates(rows: DataFrame, c: GraphConfig = GraphConfig()) -> DataFrame:
    """Active entities with any signal worth fusing."""
    z = lambda s: F.coalesce(s, F.lit(0.0))
    return rows.where((F.col("n_events") >= c.min_events) & ((z("ml") >= 0.05) | (z("graph") > 0) | (z("anomaly") >= 0.98) | (z("correlation") >= 0.5) | (z("known") >= 0.02)))


def reason_chips() -> Column:
    """Short reasons of a scored row, in a fixed order."""
    chip = lambda cond, text: F.when(cond, text)
    z = lambda s: F.coalesce(s, F.lit(0.0))
    all_of = F.array(
        chip(z("ml") >= 0.6, "model"), chip(z("anomaly") >= 0.6, "anomaly"), chip(z("graph") >= 0.5, "structure"), chip(z("correlation") >= 0.5, "network"),
        chip(z("known") >= 0.5, "known"), chip(corroborated(), "corroborated"), chip(lone_anomaly(), "lone anomaly"),
    )
    return F.filter(all_of, lambda x: x.isNotNull())


def forensic_chips() -> Column:
    """Why an entity is worth a look, in a fixed order: chain patterns, origins, money behaviour, and nearness to seeds."""
    hops = F.col("seed_hops")
    near = F.when(hops == 1, "1 hop from seed").when((hops == 2) & (F.col("seed_risk") > 0), "2 hops from seed")
    chips = F.array(
        F.when(F.col("peel_chain_txs") > 0, "peel chain"), F.when(F.col("layering_chain_txs") > 0, "rapid-hop layering"), F.when(F.col("dust_spray_txs") > 0, "dust spray"), F.when(F.col("coinjoin_txs") > 0, "CoinJoin"),
        F.when(F.col("tor_share") >= 0.25, "Tor origin"), F.when(F.col("vpn_share") >= 0.25, "hosting/VPN origin"),
        F.when((F.col("pass_through_ratio") >= 0.95) & (F.col("n_sent_txs") > 0) & (F.col("n_recv_txs") > 0), "pass-through"),
        F.when((F.col("recv_amount_cv") >= 0) & (F.col("recv_amount_cv") < 0.15), "uniform inbound amounts"), F.when(F.col("max_n_in_sent") >= 10, "consolidation"),
        F.when(F.col("is_seed"), "seed (known illicit)").otherwise(F.when(F.col("seed_risk") > 0, near)),
    )
    return F.filter(chips, lambda x: x.isNotNull())


def structural(rows: DataFrame) -> Column:
    """Noisy-or of the structural signs of an entity (counts of its transactions by pattern, longest chain, exposure of neighbours)."""
    chain = F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.col("max_peel_chain_len") / 8))
    terms = [
        F.when(F.col("peel_chain_txs") > 0, 0.55 * chain).otherwise(0.0), F.when(F.col("layering_chain_txs") > 0, 0.60).otherwise(0.0), F.when(F.col("dust_spray_txs") > 0, 0.45).otherwise(0.0),
        F.when(F.col("coinjoin_txs") > 0, 0.12).otherwise(0.0), F.when(F.col("consolidation_txs") >= 2, 0.08).otherwise(0.0),
    ]
    if "nbr_heuristic_exposure" in rows.columns:
        terms.append(0.25 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("nbr_heuristic_exposure"))))
    return noisy_or(*terms)


def default_scores(tx: DataFrame, scores: DataFrame) -> DataFrame:
    """(tx, score, tier, is_synthetic) of every transaction of (tx, illicit): its own of ``scores``, else 80 for illicit ones and 10."""
    out = tx.join(scores, "tx", "left")
    plain = F.when(F.coalesce("illicit", F.lit(False)), 80.0).otherwise(10.0)
    known = F.when(F.coalesce("illicit", F.lit(False)), "HIGH").otherwise("LOW")
    return out.select("tx", F.coalesce("score", plain).alias("score"), F.coalesce("tier", known).alias("tier"), F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"))


def latest_verdicts(feedback: DataFrame) -> DataFrame:
    """(entity, verdict): the last one given; 'unsure' clears."""
    return feedback.groupBy("entity").agg(F.max_by("verdict", "id").alias("verdict")).where("verdict <> 'unsure'")


def override_labels(seeds: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(entity, label) with feedback before seeds."""
    both = seeds.select("entity", "label", F.lit(0).alias("priority")).unionByName(verdicts.select("entity", "label", F.lit(1).alias("priority")))
    return both.groupBy("entity").agg(F.max_by("label", "priority").alias("label"))


def uncertain(rows: DataFrame, labelled: DataFrame, k: int = 25) -> DataFrame:
    """The k rows to label next: probability nearest to one half, among active scored rows without a label."""
    u = 1 - 2 * F.abs(F.col("ml") - 0.5)
    return rows.where((F.col("score") > 0) & F.col("ml").isNotNull()).join(labelled, "entity", "left_anti").withColumn("uncertainty", F.round(u, 6)).orderBy(F.desc("uncertainty"), F.asc("entity")).limit(k)
