"""Per-transaction chain heuristics over (tx, inputs, outputs) relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.config import HeuristicConfig
from cairnflow.durable import stash


def units(c: HeuristicConfig):
    return F.rint(F.col("amount") * c.unit).cast("long")


def lifecycle(tx: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(addr, first_recv_tx, first_spend_tx, first_seen_tx, first_recv_ts), -1 for never. Transactions are in time order."""
    recv = outputs.groupBy("addr").agg(F.min("tx_idx").alias("r"))
    spend = inputs.groupBy("addr").agg(F.min("tx_idx").alias("s"))
    both = recv.join(spend, "addr", "full_outer").join(tx.select(F.col("tx_idx").alias("r"), F.col("ts").alias("recv_ts")), "r", "left")
    never = F.lit(-1).cast("long")
    return both.select(
        "addr", F.coalesce("r", never).alias("first_recv_tx"), F.coalesce("s", never).alias("first_spend_tx"), F.least("r", "s").alias("first_seen_tx"), F.coalesce("recv_ts", never).alias("first_recv_ts")
    )


def pools(tx: DataFrame, inputs: DataFrame, outputs: DataFrame, c: HeuristicConfig) -> DataFrame:
    """(tx_idx, equal, n_in_addr, is_pool): many outputs of one amount paid by several addresses."""
    equal = outputs.groupBy("tx_idx", units(c).alias("u")).agg(F.count(F.lit(1)).alias("k")).groupBy("tx_idx").agg(F.max("k").alias("equal"))
    addrs = inputs.select("tx_idx", "addr").distinct().groupBy("tx_idx").agg(F.count(F.lit(1)).alias("n_in_addr"))
    rows = tx.select("tx_idx", "n_out").join(equal, "tx_idx", "left").join(addrs, "tx_idx", "left").fillna(0, ["equal", "n_in_addr"])
    is_pool = (F.col("equal") >= c.pool_min_equal) & (F.col("n_in_addr") >= c.pool_min_inputs) & (F.col("equal") / F.greatest("n_out", F.lit(1)) >= c.pool_min_share)
    return rows.select("tx_idx", "equal", "n_in_addr", is_pool.alias("is_pool"))


def dust(tx: DataFrame, outputs: DataFrame, c: HeuristicConfig) -> DataFrame:
    """(tx_idx, dust_outputs, is_dust)."""
    n = outputs.groupBy("tx_idx").agg(F.count_if(units(c) <= c.dust_units).alias("dust_outputs"))
    rows = tx.select("tx_idx", "n_out").join(n, "tx_idx", "left").fillna(0, ["dust_outputs"])
    return rows.select("tx_idx", "dust_outputs", ((F.col("dust_outputs") >= c.dust_min_outputs) & (F.col("dust_outputs") >= c.dust_min_share * F.col("n_out"))).alias("is_dust"))


def change(tx: DataFrame, outputs: DataFrame, life: DataFrame, pool: DataFrame, c: HeuristicConfig) -> DataFrame:
    """(tx_idx, change_addr, confidence, round_payment) of every two-output candidate; change_addr is null below the gate.

    A side scores for being seen first here, for not being round, and for being much larger; the other side's score halves."""
    two = tx.where((F.col("n_out") == 2) & (F.col("n_in") >= 1)).join(pool.where(~F.col("is_pool")).select("tx_idx"), "tx_idx", "left_semi").select("tx_idx")
    sides = outputs.join(two, "tx_idx").join(life.select("addr", "first_seen_tx"), "addr").select(
        "tx_idx", "pos", "addr", units(c).alias("u"), (F.col("first_seen_tx") == F.col("tx_idx")).alias("new"), (units(c) % c.round_units == 0).alias("round")
    )
    side = F.struct("addr", "u", "new", "round")
    pair = sides.groupBy("tx_idx").agg(F.min_by(side, "pos").alias("p"), F.max_by(side, "pos").alias("q"))

    def score(k: str, o: str):
        new, other_new, rnd, other_rnd = F.col(f"{k}.new"), F.col(f"{o}.new"), F.col(f"{k}.round"), F.col(f"{o}.round")
        add = lambda cond, w: F.when(cond, w).otherwise(0.0)
        return (
            add(new & ~other_new, 0.5) + add(~rnd & other_rnd, 0.3) + add(new & ~rnd & other_new & other_rnd, 0.15) + add(new & ~rnd, 0.15) + add(F.col(f"{k}.u") >= 4 * F.col(f"{o}.u"), 0.45)
        )

    rows = pair.withColumn("sp", score("p", "q")).withColumn("sq", score("q", "p"))
    first = F.col("sp") >= F.col("sq")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.greatest("sp", "sq") - 0.5 * F.least("sp", "sq")))
    addr, other_round = F.when(first, F.col("p.addr")).otherwise(F.col("q.addr")), F.when(first, F.col("q.round")).otherwise(F.col("p.round"))
    return rows.select("tx_idx", F.when(conf >= c.change_min_confidence, addr).alias("change_addr"), conf.alias("confidence"), other_round.alias("round_payment"))


def successors(links: DataFrame, tx: DataFrame, life: DataFrame, gap_s: int | None = None) -> DataFrame:
    """(tx_idx, next): the transaction that first spends ``addr`` of (tx_idx, addr), if later and, if asked, within the gap."""
    nxt = links.join(life.select("addr", F.col("first_spend_tx").alias("next")), "addr").where(F.col("next") > F.col("tx_idx"))
    if gap_s is None:
        return nxt.select("tx_idx", "next")
    at, to = tx.select("tx_idx", F.col("ts").alias("t0")), tx.select(F.col("tx_idx").alias("next"), F.col("ts").alias("t1"))
    return nxt.join(at, "tx_idx").join(to, "next").where(F.col("t1") - F.col("t0") <= gap_s).select("tx_idx", "next")


def valid_peels(tx: DataFrame, pool: DataFrame, found: DataFrame, nxt: DataFrame, c: HeuristicConfig) -> DataFrame:
    """(tx_idx) that may stand in a peel chain: change was found, or a chain reaches it and it has two outputs; few inputs; not pooled.
    ``found`` has the transactions with change, ``nxt`` their successors (tx_idx, next)."""
    reached = nxt.select(F.col("next").alias("tx_idx")).distinct().withColumn("reached", F.lit(True))
    rows = tx.join(pool.select("tx_idx", "is_pool"), "tx_idx").join(found.select("tx_idx", F.lit(True).alias("has")), "tx_idx", "left").join(reached, "tx_idx", "left")
    return rows.where((F.col("has").isNotNull() | (F.col("reached").isNotNull() & (F.col("n_out") == 2))) & (F.col("n_in") <= c.peel_max_inputs) & ~F.col("is_pool")).select("tx_idx")


def peel_links(tx: DataFrame, life: DataFrame, pool: DataFrame, changes: DataFrame, c: HeuristicConfig) -> DataFrame:
    """(tx_idx, next) between valid peel transactions."""
    found = changes.where(F.col("change_addr").isNotNull()).select("tx_idx", F.col("change_addr").alias("addr"))
    nxt = stash(successors(found, tx, life, c.peel_gap_s), "successors")
    valid = valid_peels(tx, pool, found, nxt, c)
    return nxt.join(valid, "tx_idx", "left_semi").join(valid.select(F.col("tx_idx").alias("next")), "next", "left_semi").select("tx_idx", "next")


def rapid_hops(tx: DataFrame, inputs: DataFrame, life: DataFrame, pool: DataFrame, c: HeuristicConfig) -> DataFrame:
    """(tx_idx): one output, and no input that rested longer than the dwell limit; a never-received input counts as long rested."""
    rest = inputs.join(life.select("addr", "first_recv_ts"), "addr").join(tx.select("tx_idx", "ts"), "tx_idx")
    slow = rest.groupBy("tx_idx").agg(F.count_if(F.col("ts") - F.col("first_recv_ts") > c.hop_dwell_s).alias("slow"))
    one = tx.where((F.col("n_out") == 1) & (F.col("n_in") >= 1)).join(pool.where(~F.col("is_pool")).select("tx_idx"), "tx_idx", "left_semi")
    return one.join(slow.where("slow = 0"), "tx_idx", "left_semi").select("tx_idx")


def layer_links(hops: DataFrame, tx: DataFrame, outputs: DataFrame, life: DataFrame) -> DataFrame:
    """(tx_idx, next) between rapid hops."""
    nxt = successors(outputs.join(hops, "tx_idx", "left_semi").select("tx_idx", "addr"), tx, life)
    return nxt.join(hops.select(F.col("tx_idx").alias("next")), "next", "left_semi").select("tx_idx", "next")


def fans(tx: DataFrame, pool: DataFrame, dusts: DataFrame, c: HeuristicConfig) -> DataFrame:
    """(tx_idx, consolidation, batch_payout)."""
    rows = tx.join(pool.select("tx_idx", "is_pool"), "tx_idx").join(dusts.select("tx_idx", "is_dust"), "tx_idx")
    return rows.select(
        "tx_idx", ((F.col("n_in") >= c.fan) & (F.col("n_out") <= c.fan_other) & ~F.col("is_pool")).alias("consolidation"),
        ((F.col("n_out") >= c.fan) & ~F.col("is_pool") & ~F.col("is_dust")).alias("batch_payout"),
    )


def validation(flags: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_flagged, n_true, hits, precision, recall) of a (tx_idx) flag set against a (tx_idx) truth set."""
    both = flags.select("tx_idx", F.lit(1).alias("f")).join(truth.select("tx_idx", F.lit(1).alias("t")), "tx_idx", "full_outer")
    n = both.agg(F.count("f").alias("n_flagged"), F.count("t").alias("n_true"), F.count(F.col("f") + F.col("t")).alias("hits"))
    return n.withColumn("precision", F.coalesce(F.try_divide("hits", "n_flagged"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("hits", "n_true"), F.lit(0.0)))


