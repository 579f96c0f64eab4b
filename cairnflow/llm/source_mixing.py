"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words. Among all document rates r in [0, cap] whose expected words meet the targets, the rates
nearest in relative entropy to one copy each are r = min(cap, exp(lambda * size / mean size)), with one multiplier for each
source's token constraint. The convex dual is solved by Newton steps; every step is one distributed aggregation over the
histogram of (source, size), whose rows sum to the documents. Rates are then rounded to whole copies, with the error in words
carried from document to document, so that the taken words of every block come near their expectation.

Defined cases: a null text has size 0; documents of size 0 are never taken; the null source is a source and comes last; rows
repeated with the same id are separate documents with rates of their own; one source may hold most rows, since blocks of bounded size
are rounded apart; an empty table gives an empty result; extra columns are ignored by ``mix`` and kept by ``mixed_rows``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnflow.llm.common import field, read, release, rows_of, stash, tie_of
from cairnflow.operators.ordered import running

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Documents rounded together; error is carried within a block only.
BLOCK = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Water-filling over the sources table (source, n, words): target = min(cap * words, weight * level).

    Resharing the excess by weight until no source is above its cap ends at that level; it is read off running sums over the
    sources in the order in which they fill up. Sums run by range, so there may be many sources.
    """
    by_name = [F.col("source").asc_nulls_last()]
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    s = running(sizes, by_name, {"at": F.lit(1)}).withColumn("weight", F.element_at(cyc, ((F.col("at") - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("words") * F.lit(float(cap))).withColumn("fills_at", F.col("most") / F.col("weight"))
    s = running(s, [F.col("fills_at").asc(), *by_name], {"most_to": F.col("most"), "weight_to": F.col("weight")})
    n, words = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    weight = n // len(weights) * sum(weights) + sum(weights[: n % len(weights)])
    level = (F.lit(float(share * words)) - F.col("most_to") + F.col("most")) / (F.lit(float(weight)) - F.col("weight_to") + F.col("weight"))
    s = stash(s.withColumn("level", level), "levels")
    first = s.where(F.col("level") <= F.col("fills_at")).agg(F.min_by("level", F.struct("fills_at", F.col("source").isNull().alias("last"), "source"))).first()[0]
    level = F.lit(float("inf") if first is None else first)
    return s.select("source", "n", "words", F.least("most", F.col("weight") * level).alias("target"), "most")


def balance(histogram: DataFrame, goals: DataFrame, cap: float = CAP, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(source, n, words, target, lam, full): the dual solution. ``full`` marks sources whose target needs every rate at the cap.

    A Newton step that leaves the bracket known to hold the root is replaced by bisection, so each source converges; if one
    hasn't after ``steps`` steps, that raises.
    """
    lam = goals.select(
        "source", "n", "words", "target",
        (F.col("target") >= F.col("most") * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"),
    )
    lam = stash(lam, "dual")
    for _ in range(steps):
        before, lam = lam, stash(newton_step(histogram, lam, cap, tolerance), "dual")
        release(before)
        if not lam.where(~F.col("done")).take(1):
            return lam.select("source", "n", "words", "target", "full", "lam")
    raise RuntimeError(f"the dual did not converge in {steps} steps")


def newton_step(histogram: DataFrame, lam: DataFrame, cap: float, tolerance: float) -> DataFrame:
    """One step for the sources that aren't done: the words that their rates give and the slope, summed over the histogram."""
    x = F.col("size") * F.col("m.n") / F.col("m.words")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(700.0))))
    live = lam.where(~F.col("done") & ~F.col("full") & (F.col("words") > 0))
    sums = (
        histogram.alias("h").join(live.alias("m"), F.col("h.source").eqNullSafe(F.col("m.source")))
        .groupBy(F.col("m.source").alias("source"))
        .agg(F.sum(F.col("docs") * F.col("size") * rate).alias("got"), F.sum(F.when(rate < cap, F.col("docs") * F.col("size") * rate * x).otherwise(0.0)).alias("slope"))
    )
    gap = F.col("got") - F.col("target")
    low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
    step = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
    inside = step.isNotNull() & F.coalesce(step > low, F.lit(True)) & F.coalesce(step < high, F.lit(True))
    middle = F.when(high.isNull(), low * 2 + 1).when(low.isNull(), high * 2 - 1).otherwise((low + high) / 2)
    return lam.alias("l").join(sums.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source")), "left").select(
        "l.source", "n", "words", "target", "full",
        F.when(F.col("got").isNull() | (F.abs(gap) <= F.col("target") * tolerance), F.col("lam")).when(inside, step).otherwise(middle).alias("lam"),
        low.alias("low"), high.alias("high"), (F.col("done") | F.col("got").isNull() | (F.abs(gap) <= F.col("target") * tolerance)).alias("done"),
    )


def round_rates(rows: DataFrame, schema: str, cap: float = CAP) -> DataFrame:
    """Copies of each row from its rate, block by block: largest first, each rounded so as to bring the words taken so far nearest
    to the words expected so far."""

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "tie", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
        size, rate = block["size"].to_numpy(), block["rate"].to_numpy()
        copies, owed = np.zeros(len(size), dtype=np.int64), 0.0
        for i, (n, r) in enumerate(zip(size.tolist(), rate.tolist(), strict=True)):
            if n:
                owed += n * r
                lo = int(r)
                k = lo if abs(owed - n * lo) <= abs(owed - n * (lo + 1)) else lo + 1
                k = min(k, int(cap))
                copies[i] = k
                owed -= n * k
        return block.assign(copies=copies).drop(columns=["rate", "block", "block_source"])

    return rows.groupBy("block_source", "block").applyInPandas(one, schema)


def _mixed(
    rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, cap: float
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and the key of each row of ``rows`` (of ``rows_of``)."""
    picked = rows.select("row", field(id_col).alias("doc_id"), field(source_col).cast("string").alias("source"), word_count(field(text_col)).alias("size"), tie_of(docs).alias("tie"))
    sized = stash(picked, "sizes")
    histogram = stash(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("size")).alias("words"))
    dual = balance(histogram, targets(sizes, weights, share, cap), cap)
    x = F.col("size") * F.col("n") / F.col("words")
    rate = F.when(F.col("words") == 0, 0.0).when(F.col("full"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(700.0)))))
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    rated = sized.alias("d").join(dual.alias("m"), F.col("d.source").eqNullSafe(F.col("m.source"))).select(
        "row", "doc_id", "d.source", "size", F.col("words").alias("source_size"), "target", "tie", rate.alias("rate"),
        F.coalesce(F.col("d.source"), F.lit("")).alias("block_source"),
        (F.pmod(F.xxhash64("doc_id", "tie"), blocks) * 2 + F.col("d.source").isNull().cast("int")).alias("block"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    return round_rates(rated, f"row binary, doc_id {kind}, source string, size bigint, source_size bigint, target double, tie bigint, copies bigint", cap)


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken words (size * copies)."""
    out = _mixed(rows_of(docs), docs, id_col, text_col, source_col, weights, share, cap)
    return out.drop("row", "tie").withColumn("taken", F.col("copies") * F.col("size"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with its own columns whatever their names. Rows of no copies go,
    among them empty and null texts; repeated rows are taken one by one, and null ids and sources are as good as any; an empty
    table gives an empty result."""
    rows = rows_of(docs)
    taken = stash(_mixed(rows, docs, id_col, text_col, source_col, weights, share, cap).where(F.col("copies") > 0).select("row", "copies"), "taken")
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return rows.join(taken.hint("merge"), "row").select("own", times.alias("copy")).select("own.*")
