"""From a raw file to ranked leads: parse, flatten, heuristics, entities, network evidence, graph signals, model, fusion, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.config import FORENSIC, EntityConfig, ForensicsConfig, GraphConfig, HeuristicConfig, RiskConfig
from cairnflow.durable import stash
from cairnflow.functions.scalars import temporal_burst
from cairnflow.operators import chains, entities, flatten, graph, heuristics, ingest, ml, risk
from cairnflow.sources import raw, synth


@dataclass
class Dataset:
    """Flattened transactions, with the counts of dropped rows."""

    tx: DataFrame
    inputs: DataFrame
    outputs: DataFrame
    obs: DataFrame
    dropped: DataFrame


@dataclass
class Prepared:
    """What scoring needs: features (entity, …), summed flows, members (addr, entity), sent (entity, tx_idx, amount), flags and hubs."""

    features: DataFrame
    flows: DataFrame
    members: DataFrame
    sent: DataFrame
    flags: DataFrame
    hubs: DataFrame


@dataclass
class Result:
    features: DataFrame
    flows: DataFrame
    members: DataFrame
    leads: DataFrame
    prepared: Prepared | None = None
    labels: str = "none"
    peers: DataFrame | None = None


#: Columns of the feature matrix by family; the others are behaviour.
FAMILIES = {
    "network": ("tor_share", "vpn_share", "n_origin_ips", "n_origin_countries", "top_ip_share", "rapid_geo_hops", "network_obfuscation"),
    "heuristics": ("coinjoin_txs", "dust_spray_txs", "peel_chain_txs", "layering_chain_txs", "consolidation_txs", "batch_payout_txs", "max_peel_chain_len", "max_layering_chain_len"),
    "graph": ("nbr_heuristic_exposure", "nbr2_heuristic_exposure", "nbr_mean_pass_through", "nbr_tor_share"),
}
EMBEDDING = "emb_"


def families(columns: list[str]) -> dict[str, list[str]]:
    """The feature columns by family: behavioural, network, heuristics, graph, embeddings."""
    special = {c for v in FAMILIES.values() for c in v}
    own = [c for c in columns if c != "entity"]
    out = {"behavioural": [c for c in own if c not in special and not c.startswith(EMBEDDING)]}
    out |= {k: [c for c in v if c in own] for k, v in FAMILIES.items()}
    return out | {"embeddings": [c for c in own if c.startswith(EMBEDDING)]}


def load(raw: DataFrame, unit: float | None = None) -> Dataset:
    """Clean and flatten raw rows. Amounts are detected as smallest units or whole ones unless ``unit`` says what divides them."""
    rows, _ = ingest.canonical(raw)
    parsed = stash(ingest.parse_rows(rows, ingest.epoch_unit(rows)).withColumn("row", F.monotonically_increasing_id()), "parsed")
    good = parsed.where(F.col("drop_reason").isNull())
    if unit is None:
        seen = ingest.detect_unit(good.select("row", F.col("ov").alias("output_amounts")), "row").first()
        unit = 1e8 if seen["small_units"] else 1.0
    first = flatten.first_observations(good, "txid", "ts", "row")
    first = stash(flatten.dense_index(first, "tx_idx", F.floor(F.col("ts") / 86400), ["ts", "row"]), "first")
    scaled = first.withColumns({c: F.transform(c, lambda x: x / unit) for c in ("iv", "ov")})
    inputs, outputs = flatten.explode_sides(scaled, "tx_idx", "ia", "iv"), flatten.explode_sides(scaled, "tx_idx", "oa", "ov")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    fee = flatten.derive_fee(F.col("fee").try_cast("double") / unit, F.size("ia"), total("iv"), total("ov"))
    tx = scaled.select("tx_idx", "txid", F.col("ts").cast("long").alias("ts"), fee.alias("fee"), ingest.clean_script(F.col("script_type")).alias("script_type"), F.size("ia").cast("bigint").alias("n_in"), F.size("oa").cast("bigint").alias("n_out"))
    obs = good.join(scaled.select("txid", "tx_idx"), "txid").select("tx_idx", "row", "ts", "src_ip", "dst_ip", F.coalesce("geo_country", F.lit("")).alias("country"))
    return Dataset(stash(tx, "tx"), stash(inputs, "inputs"), stash(outputs, "outputs"), stash(obs, "obs"), ingest.drop_reasons(parsed))


def network_evidence(d: Dataset, sent: DataFrame, tor: DataFrame | None = None, hosting: DataFrame | None = None, e: EntityConfig = EntityConfig()) -> DataFrame:
    """(entity, network columns) from the first observation of each transaction that an entity sent: distinct origins and countries, the
    share of the commonest origin, shares of listed exit nodes (``tor``: ip) and hosting networks (``hosting``: ip), rapid changes of
    country, and the obfuscation that these make."""
    first = flatten.first_observations(d.obs, "tx_idx", "ts", "row").select("tx_idx", "ts", "row", F.coalesce("src_ip", F.lit("")).alias("ip"), "country")
    flag = lambda rows, listed, name: rows.withColumn(name, F.lit(0.0)) if listed is None else rows.join(F.broadcast(listed.select("ip", F.lit(1.0).alias(name)).distinct()), "ip", "left").fillna(0.0, [name])  # noqa: E731  lists of some thousand addresses
    rows = stash(flag(flag(sent.select("entity", "tx_idx").join(first, "tx_idx"), tor, "tor"), hosting, "vpn"), "origins")
    shares = rows.groupBy("entity").agg(F.avg("tor").alias("tor_share"), F.avg("vpn").alias("vpn_share"))
    out = entities.network_shares(rows).drop("n").join(entities.origin_link(rows).select("entity", "top_ip_share"), "entity").join(shares, "entity")
    out = out.join(entities.rapid_changes(rows, "country", e.rapid_hop_s, ["ts", "row"]).withColumnRenamed("rapid", "rapid_geo_hops"), "entity")
    return out.withColumn("network_obfuscation", entities.obfuscation(F.col("tor_share"), F.col("vpn_share"), F.col("rapid_geo_hops")))


def prepare(
    d: Dataset, h: HeuristicConfig = HeuristicConfig(), e: EntityConfig = EntityConfig(), g: GraphConfig = GraphConfig(), f: ForensicsConfig = ForensicsConfig(),
    tor: DataFrame | None = None, hosting: DataFrame | None = None,
) -> Prepared:
    """Heuristics, entities and all features of a dataset, without labels."""
    pool = stash(heuristics.pools(d.tx, d.inputs, d.outputs, h), "pools")
    life = stash(heuristics.lifecycle(d.tx, d.inputs, d.outputs), "life")
    dusts = stash(heuristics.dust(d.tx, d.outputs, h), "dusts")
    changes = stash(heuristics.change(d.tx, d.outputs, life, pool, h), "changes")
    peels = chains.follow(heuristics.peel_links(d.tx, life, pool, changes, h), h.peel_min_length)
    hops = stash(heuristics.rapid_hops(d.tx, d.inputs, life, pool, h), "hops")
    layers = chains.follow(heuristics.layer_links(hops, d.tx, d.outputs, life), h.layer_min_length)
    flags = (
        d.tx.select("tx_idx").join(pool.select("tx_idx", "is_pool"), "tx_idx").join(dusts.select("tx_idx", "is_dust"), "tx_idx").join(heuristics.fans(d.tx, pool, dusts, h), "tx_idx")
        .join(peels.select("tx_idx", F.col("length").alias("peel")), "tx_idx", "left").join(layers.select("tx_idx", F.col("length").alias("layering")), "tx_idx", "left").fillna(0, ["peel", "layering"])
    )
    flags = stash(flags, "flags")
    member = stash(d.inputs.select("addr").union(d.outputs.select("addr")).distinct(), "addresses")
    # Dense numbers by a prefix of a hash: some 10,000 addresses a bucket, however many there are.
    digits = 2 if (n := member.count()) <= 10_000 * 256 else min(10, 2 + (max(1, n // 2_560_000)).bit_length() // 4 + 1)
    ids = stash(flatten.dense_index(member, "node", F.substring(F.md5(F.col("addr").cast("string")), 1, digits), ["addr"]), "ids")
    edges = entities.ownership_edges(d.tx, d.inputs, pool, changes, e)
    edges = edges.join(ids.select(F.col("addr").alias("src"), F.col("node").alias("a")), "src").join(ids.select(F.col("addr").alias("dst"), F.col("node").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = entities.resolve(ids.select(F.col("node").alias("addr")), edges).select(F.col("addr").alias("node"), "entity")
    members = stash(ids.join(found, "node").select("addr", "entity"), "members")
    sent = stash(entities.sent(d.inputs, members), "sent")
    external = stash(entities.external_outputs(d.outputs, members, sent), "external")
    recv = stash(entities.received(external), "recv")
    flow = stash(entities.flows(d.tx, d.inputs, d.outputs, members, pool, external), "flows")
    spine = stash(members.groupBy("entity").agg(F.count(F.lit(1)).alias("n_addresses")), "spine")
    events = stash(entities.events_of(sent, recv, d.tx), "events")
    s, v = entities.sent_stats(sent, d.tx), entities.recv_stats(recv)
    took = sent.join(flags, "tx_idx").groupBy("entity").agg(
        *[F.sum(F.col(a).cast("long")).alias(b) for a, b in (("is_pool", "coinjoin_txs"), ("is_dust", "dust_spray_txs"), ("consolidation", "consolidation_txs"), ("batch_payout", "batch_payout_txs"))],
        F.count_if(F.col("peel") > 0).alias("peel_chain_txs"), F.count_if(F.col("layering") > 0).alias("layering_chain_txs"), F.max("peel").alias("max_peel_chain_len"), F.max("layering").alias("max_layering_chain_len"),
    )
    degree = stash(entities.degrees(flow), "degrees")
    matrix = entities.feature_matrix(
        spine, s, v, entities.pass_through(spine.select("entity"), s, v), degree, entities.activity(events, e), entities.peak_hour(events), entities.dwell(d.inputs, d.tx, life, members, e),
        entities.receipt_uniformity(recv, e), took, network_evidence(d, sent, tor, hosting, e),
    )
    matrix = stash(matrix, "matrix")
    walk = stash(graph.normalised(graph.adjacency(flow, g)), "walk")
    hit = graph.structural_indicator(matrix.withColumnRenamed("entity", "node"))
    values = hit.join(matrix.select(F.col("entity").alias("node"), F.col("pass_through_ratio").alias("pass"), F.col("tor_share").alias("tor")), "node")
    one = stash(graph.propagate(walk, values, ["x", "pass", "tor"]), "one")
    two = graph.propagate(walk, one, ["x"]).select("node", F.col("x").alias("nbr2_heuristic_exposure"))
    exposure = one.select("node", F.col("x").alias("nbr_heuristic_exposure"), F.col("pass").alias("nbr_mean_pass_through"), F.col("tor").alias("nbr_tor_share")).join(two, "node", "left")
    features = matrix.join(exposure.withColumnRenamed("node", "entity"), "entity", "left").fillna(0.0)
    if f.embedding_dims:
        emb = ml.ppmi_embedding(flow, f.embedding_dims)
        features = features.join(emb.select(F.col("node").alias("entity"), *[F.col("embedding")[i].alias(f"{EMBEDDING}{i}") for i in range(f.embedding_dims)]), "entity", "left").fillna(0.0)
    hub = stash(risk.hubs(degree, spine, g).select(F.col("entity").alias("node")), "hubs")
    return Prepared(stash(features, "features"), flow, members, sent, flags, hub)


def assembled(features: DataFrame, columns: list[str]) -> DataFrame:
    """(id, features) of a feature matrix."""
    return VectorAssembler(inputCols=columns, outputCol="features").transform(features).select(F.col("entity").alias("id"), "features")


def probabilities(p: Prepared, labels: DataFrame | None, columns: list[str], f: ForensicsConfig, g: GraphConfig) -> tuple[DataFrame, str]:
    """((entity, ml), source of the labels). ``labels`` is (entity, label) or (entity, label, campaign); entities of a campaign are never on
    both sides of a fold. Without labels the model is one trained on a synthetic economy, if the configuration wants that."""
    active = p.features.where(F.col("n_events") >= g.min_events)
    if labels is not None:
        known = labels if "campaign" in labels.columns else labels.withColumn("campaign", F.lit(-1).cast("bigint"))
        rows = ml.assign_folds(active.select("entity").join(known, "entity", "left"), f.folds if labels.limit(f.small_labels).count() >= f.small_labels else f.small_folds)
        rows = rows.select(F.col("entity").alias("id"), F.col("label").cast("double").alias("label"), "fold").join(assembled(active, columns), "id")
        return ml.out_of_fold(rows, f.trees, f.max_negatives).select(F.col("id").alias("entity"), F.col("calibrated").alias("ml")), "labels"
    if f.transfer_tx:
        model = transferred(active.sparkSession, f, g, columns)
        if model is not None:
            return ml.probability(model, assembled(active, columns)).select(F.col("id").alias("entity"), F.col("p").alias("ml")), "transfer_from_synthetic"
    return active.select("entity", F.lit(None).cast("double").alias("ml")), "none"


def transferred(spark, f: ForensicsConfig, g: GraphConfig, columns: list[str]):
    """A forest trained on the entities of a synthetic economy with the same features; None if it holds too few illicit ones."""
    rows = synth.scenario_payments(spark, synth.ScenarioConfig(n_tx=f.transfer_tx, seed=f.seed + 1))
    rows = stash(rows, "economy")
    d = load(raw.as_strings(rows.drop("kind", "scenario", "campaign")), unit=1.0)
    p = prepare(d, g=g, f=f)
    y = entity_truth(p, synth.truth(rows)).select("entity", F.col("is_illicit").cast("double").alias("label"))
    train = assembled(p.features.where(F.col("n_events") >= g.min_events), columns).join(y.withColumnRenamed("entity", "id"), "id")
    train = ml.negatives_capped(stash(train, "transfer"), f.max_negatives)
    return ml.forest(train, f.trees) if train.where("label = 1").limit(2).count() == 2 else None


def entity_truth(p: Prepared, truth: DataFrame) -> DataFrame:
    """(entity, illicit_share, is_illicit, scenario, campaign) from (addr, illicit, scenario, campaign)."""
    campaign = p.members.join(truth.select("addr", "campaign"), "addr").groupBy("entity").agg(F.max("campaign").alias("campaign"))
    return entities.labels_from_truth(p.members, truth).join(campaign, "entity")


def score(
    p: Prepared, seeds: DataFrame | None = None, labels: DataFrame | None = None, g: GraphConfig = GraphConfig(), r: RiskConfig = FORENSIC, f: ForensicsConfig = ForensicsConfig(), columns: list[str] | None = None,
) -> Result:
    """Ranked leads. ``seeds`` (entity) are known already and raise what is near them; ``labels`` (entity, label[, campaign]) train."""
    columns = columns or [c for c in p.features.columns if c != "entity"]
    x = p.features
    plain = [c for c in columns if not c.startswith(EMBEDDING)]
    active = x.where(F.col("n_events") >= g.min_events)
    odd = ml.isolation_scores(active.select(F.col("entity").alias("id"), F.array(*[F.col(c).cast("double") for c in plain]).alias("x"))).select(F.col("id").alias("entity"), F.col("percentile").alias("anomaly"))
    found, source = probabilities(p, labels, columns, f, g)
    burst = temporal_burst(F.col("peak_events"), F.col("n_events"), F.col("burstiness"))
    rows = x.select("entity", "n_events", risk.structural(x).alias("graph"), F.col("network_obfuscation").alias("network"), burst.alias("burst")).join(odd, "entity", "left").join(found, "entity", "left")
    if seeds is not None and seeds.take(1):
        near = graph.seed_risk(p.flows, seeds.select(F.col("entity").alias("node")).distinct(), p.hubs, g)
        rows = rows.join(near.select(F.col("node").alias("entity"), F.col("hops").alias("seed_hops"), F.col("nearest").alias("seed_nearest"), F.col("risk").alias("seed_risk"), "is_seed"), "entity", "left")
    else:
        rows = rows.withColumns({"seed_hops": F.lit(None).cast("int"), "seed_nearest": F.lit(None).cast("bigint"), "seed_risk": F.lit(0.0), "is_seed": F.lit(False)})
    rows = stash(rows.fillna({"is_seed": False, "seed_risk": 0.0, "seed_hops": -1, "seed_nearest": -1}), "signals")
    worth = risk.candidates(rows.withColumns({"correlation": F.col("network"), "known": F.col("seed_risk")}), g)
    none = F.lit(None).cast("double")
    worth = worth.withColumns({"correlation": none, "known": none})
    custom = F.create_map(F.lit("network_obfuscation"), F.coalesce("network", F.lit(0.0)), F.lit("temporal_burst"), F.coalesce("burst", F.lit(0.0)))
    scored = risk.boosted(risk.fuse(worth, "weighted", r, custom), r)
    rest = rows.join(worth.select("entity"), "entity", "left_anti").withColumns({"correlation": none, "known": none, "score": F.lit(0.0), "tier": F.lit(r.lowest), "is_synthetic": F.lit(False), "score_base": F.lit(0.0)})
    groups, described = ml.peer_groups(x, "entity", columns, f.peer_groups, active=F.col("n_events") >= g.min_events)
    leads = risk.rank_leads(stash(scored.unionByName(rest).join(groups, "entity", "left"), "scored"))
    return Result(x, p.flows, p.members, stash(leads, "leads"), p, source, described)


def analyse(
    d: Dataset, seeds: DataFrame | None = None, labels: DataFrame | None = None,
    h: HeuristicConfig = HeuristicConfig(), e: EntityConfig = EntityConfig(), g: GraphConfig = GraphConfig(), r: RiskConfig = FORENSIC, f: ForensicsConfig = ForensicsConfig(),
    tor: DataFrame | None = None, hosting: DataFrame | None = None,
) -> Result:
    """Ranked leads of a dataset. ``seeds`` has known addresses (addr); ``labels`` (addr, label) trains the model, cross-fitted by entity."""
    p = prepare(d, h, e, g, f, tor, hosting)
    start = None if seeds is None else seeds.join(p.members, "addr").select("entity").distinct()
    known = None if labels is None else labels.join(p.members, "addr").groupBy("entity").agg(F.max("label").alias("label"))
    return score(p, start, known, g, r, f)


def watch_list(truth: DataFrame, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """(entity, label) of (entity, is_illicit): a share of the illicit entities, four at least, and of the others, forty at least, as if
    from a list; chosen by hash."""
    n = {r["is_illicit"]: r["n"] for r in truth.where(F.col("is_illicit").isNotNull()).groupBy("is_illicit").agg(F.count(F.lit(1)).alias("n")).collect()}
    take = lambda kind, least: truth.where(F.col("is_illicit") == kind).orderBy(F.xxhash64("entity", F.lit(seed)), "entity").limit(max(least, int(n.get(kind, 0) * fraction)))
    return take(True, 4).unionByName(take(False, 40)).select("entity", F.col("is_illicit").cast("double").alias("label"))


def retrain(res: Result, verdicts: DataFrame, seed_labels: DataFrame | None = None, g: GraphConfig = GraphConfig(), f: ForensicsConfig = ForensicsConfig()) -> tuple[Result, dict]:
    """(result, counts): scored anew with labels from feedback (entity, verdict: confirmed or dismissed), which go before ``seed_labels``.
    Fewer than two entities of either kind raise ValueError; confirmed ones become seeds."""
    given = verdicts.select("entity", (F.col("verdict") == "confirmed").cast("double").alias("label"))
    none = given.limit(0)
    labels = stash(risk.override_labels(none if seed_labels is None else seed_labels.select("entity", "label"), given), "labels")
    n = labels.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("p")).first()
    if n["p"] < 2 or n["n"] - n["p"] < 2:
        raise ValueError("retraining needs two confirmed and two dismissed entities at least")
    new = score(res.prepared, labels.where("label = 1").select("entity"), labels, g, f=f)
    return new, {"n_labels": n["n"], "n_feedback": given.count(), "n_positive": int(n["p"])}
