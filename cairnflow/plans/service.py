"""Interactive queries over an analysed dataset: alerts, entities, subgraphs, evidence and reports."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.config import ForensicsConfig
from cairnflow.functions.scalars import humanize
from cairnflow.operators import evidence, graph, risk
from cairnflow.plans.forensics import Result, retrain
from cairnflow.plans.report import lead_summary
from cairnflow.sources.store import CaseStore

STATUSES = ("new", "open", "investigating", "escalated", "dismissed", "resolved")
#: Other names under which a status arrives.
STATUS_ALIASES = {"closed": "dismissed", "in_progress": "investigating", "reviewed": "resolved"}


def status_of(name: str) -> str:
    """The canonical name of a status; an unknown one raises ValueError."""
    plain = name.strip().lower().replace(" ", "_")
    plain = STATUS_ALIASES.get(plain, plain)
    if plain not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    return plain


class Service:
    def __init__(self, result: Result, verdicts: DataFrame | None = None, store: CaseStore | None = None, dataset: str = "dataset"):
        self.r, self.store, self.dataset = result, store, dataset
        self.verdicts = verdicts if verdicts is not None or store is None else store.verdicts(dataset)

    def alerts(self, min_score: float = 0.0, min_tier: str | None = None, limit: int = 50, offset: int = 0, with_seeds: bool = False) -> tuple[int, DataFrame]:
        """Total and one page, by rank; with seeds, by score."""
        if not 1 <= limit <= 500 or offset < 0:
            raise ValueError("limit must be 1 to 500 and offset 0 or more")
        rows = self.r.leads.where((F.col("rank") > 0) | F.col("is_seed")) if with_seeds else self.r.leads.where("rank > 0")
        rows = rows.where(F.col("score") >= min_score)
        if min_tier:
            rows = rows.where(risk.tier_rank(F.col("tier")) >= risk.tier_rank(F.lit(min_tier)))
        if self.verdicts is not None:
            rows = rows.join(self.verdicts, "entity", "left")
        order = [F.desc("score"), F.asc("rank")] if with_seeds else [F.asc("rank")]
        return rows.count(), self.explained(rows).orderBy(*order).offset(offset).limit(limit)

    def explained(self, rows: DataFrame) -> DataFrame:
        """``rows`` of leads with reasons, the chips of what was seen."""
        f = self.r.features
        named = f.withColumns({"n_sent_txs": F.col("n_sent"), "n_recv_txs": F.col("n_recv"), "max_n_in_sent": F.col("max_n_in")})
        cols = ["peel_chain_txs", "layering_chain_txs", "dust_spray_txs", "coinjoin_txs", "tor_share", "vpn_share", "pass_through_ratio", "recv_amount_cv", "n_sent_txs", "n_recv_txs", "max_n_in_sent", "n_addresses"]
        return rows.join(named.select("entity", *cols), "entity").withColumn("reasons", risk.forensic_chips()).drop(*cols[:-1])

    def alert(self, alert_id: str) -> dict:
        """One alert by its id, with its current status; KeyError without."""
        row = evidence.alerts(self.r.leads.where("rank > 0"), 0.0).where(F.col("alert_id") == alert_id).first()
        if row is None:
            raise KeyError(alert_id)
        out = row.asDict()
        if self.store is not None:
            last = self.store.statuses().where(F.col("alert_id") == alert_id).first()
            out["status"] = last["status"] if last else out["status"]
        return out

    def patch_alert(self, alert_id: str, status: str) -> dict:
        """Set the status of an alert; KeyError for an unknown alert, ValueError for an unknown status."""
        new, found = status_of(status), self.alert(alert_id)
        if self.store is None:
            raise RuntimeError("a store is needed to keep a status")
        self.store.set_status(alert_id, new)
        return found | {"status": new}

    def feedback(self, entity: int, verdict: str, note: str = "") -> None:
        """Keep an analyst's verdict on an entity; KeyError for an unknown one."""
        if self.store is None:
            raise RuntimeError("a store is needed to keep feedback")
        if not self.r.leads.where(F.col("entity") == entity).take(1):
            raise KeyError(entity)
        self.store.give(self.dataset, entity, verdict, note)
        self.verdicts = self.store.verdicts(self.dataset)

    def uncertain(self, k: int = 10) -> DataFrame:
        """The leads whose label would teach most."""
        if not 1 <= k <= 100:
            raise ValueError("k must be 1 to 100")
        known = self.r.leads.limit(0).select("entity") if self.verdicts is None else self.verdicts.select("entity")
        return risk.uncertain(self.r.leads, known, k)

    def retrained(self, seed_labels: DataFrame | None = None, f: ForensicsConfig = ForensicsConfig()) -> tuple[Service, dict]:
        """A service on the result that feedback gives, and how many labels there were."""
        if self.verdicts is None:
            raise ValueError("there is no feedback")
        new, counts = retrain(self.r, self.verdicts, seed_labels, f=f)
        return Service(new, self.verdicts, self.store, self.dataset), counts

    def entity(self, entity: int) -> dict:
        """Scores, features, addresses (the first ten and how many), heuristic hits, key transactions, peers and the seed evidence of one
        entity, with a summary."""
        lead = self.explained(self.r.leads.where(F.col("entity") == entity)).first()
        if lead is None:
            raise KeyError(entity)
        mine = self.r.members.where(F.col("entity") == entity)
        flows = self.r.flows.where((F.col("src") == entity) | (F.col("dst") == entity))
        top = flows.orderBy(F.desc("amount"), "tx_idx").limit(12).orderBy("ts", "tx_idx").collect()
        span = flows.agg((F.max("ts") - F.min("ts")).cast("double").alias("s")).select(humanize(F.col("s"))).first()[0]
        hits = []
        if self.r.prepared is not None:
            sent, flags = self.r.prepared.sent.where(F.col("entity") == entity), self.r.prepared.flags
            shown = flags.select("tx_idx", F.col("is_pool").alias("coinjoin"), F.col("is_dust").alias("dust_spray"), (F.col("peel") > 0).alias("peel_chain"), (F.col("layering") > 0).alias("layering"), "consolidation", "batch_payout")
            hits = [r.asDict() for r in evidence.heuristic_hits(sent, shown).orderBy("heuristic").collect()]  # a row for each of six patterns
        n_ranked = self.r.leads.where("rank > 0").count()
        p = F.coalesce("ml", F.lit(0.0))
        told = self.r.leads.where(F.col("entity") == entity).select("*", F.lit(n_ranked).alias("n_ranked"), F.lit(lead["n_addresses"]).alias("n_addresses"), p.alias("p"), p.alias("low"), p.alias("high"), F.array(*[F.lit(x) for x in lead["reasons"]]).cast("array<string>").alias("chips"))
        peers = None if self.r.peers is None else self.r.peers.where(F.col("peer_group") == lead["peer_group"]).first()
        return {
            "lead": lead.asDict(), "features": self.r.features.where(F.col("entity") == entity).first().asDict(), "n_addresses": mine.count(), "addresses": [r["addr"] for r in mine.orderBy("addr").limit(10).collect()],
            "key_flows": [r.asDict() for r in top], "active": span, "boost": round(lead["score"] - lead["score_base"], 2), "heuristics": hits, "peer_group": None if peers is None else peers.asDict(True),
            "seed": evidence.seed_evidence(self.r.leads.where(F.col("entity") == entity).select("entity", F.col("seed_hops").alias("hops"), F.col("seed_nearest").alias("nearest"), "score", "score_base")).first().asDict(),
            "label_source": self.r.labels, "summary": told.select(lead_summary().alias("s")).first()["s"],
        }

    def subgraph(self, entity: int, radius: int = 1, max_nodes: int = 60, max_events: int = 800) -> tuple[DataFrame, DataFrame]:
        """(nodes, summed flows among them): the neighbours of most value within the radius, hubs not expanded, and both money trails."""
        nodes, edges, _ = self.neighbourhood(entity, radius, max_nodes, max_events)
        return nodes, edges

    def neighbourhood(self, entity: int, radius: int = 1, max_nodes: int = 60, max_events: int = 800) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The same, and the largest flows among the nodes, by time."""
        if not 1 <= radius <= 3 or not 5 <= max_nodes <= 150:
            raise ValueError("radius must be 1 to 3 and max_nodes 5 to 150")
        hubs = None if self.r.prepared is None else self.r.prepared.hubs
        near = graph.neighbourhood(graph.aggregated_edges(self.r.flows), entity, radius, max_nodes, hubs)
        steps = self.trail(entity).select(F.col("dst").alias("node")).unionByName(self.trail(entity, True).select(F.col("src").alias("node"))).distinct()
        nodes = near.unionByName(steps.join(near, "node", "left_anti").select("node", F.lit(None).cast("int").alias("hops")))
        inside = graph.induced(self.r.flows, nodes)
        return nodes, graph.aggregated_edges(inside), inside.orderBy(F.desc("amount"), "tx_idx", "src", "dst").limit(max_events).orderBy("ts", "tx_idx")

    def trail(self, entity: int, backward: bool = False) -> DataFrame:
        return graph.money_trail(self.r.flows, entity, hubs=None if self.r.prepared is None else self.r.prepared.hubs, backward=backward)

    def report(self, entities: list[int]) -> dict:
        """A package of 1 to 20 entities with a digest over its canonical JSON."""
        if not 1 <= len(entities) <= 20:
            raise ValueError("a report holds 1 to 20 entities")
        body = {"entities": [self.entity(e) for e in entities]}
        return {"body": body, "digest": digest(body)}


def digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def verify(package: dict) -> bool:
    return package.get("digest") == digest(package["body"])
