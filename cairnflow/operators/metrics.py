"""Ranking and classification metrics of (y, score) rows.

Rows of one score are counted together first, so the ordered tables hold distinct scores, not rows; they are summed up by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.operators.ordered import running


def curve(rows: DataFrame) -> DataFrame:
    """(score, tp, fp) at each distinct cut-off, largest first."""
    steps = rows.groupBy("score").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("n"))
    return running(steps, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")})


def ap_auc(rows: DataFrame) -> DataFrame:
    """(average_precision, roc_auc), ties grouped."""
    c = curve(rows)
    return c.agg(
        (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")).alias("average_precision"),
        (F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n"))).alias("roc_auc"),
    )


def best_f1(rows: DataFrame) -> DataFrame:
    """(score, precision, recall, f1) at the cut-off of the largest F1, ties to the larger score."""
    total = rows.agg(F.sum(F.col("y").cast("long")).alias("positives"))
    c = curve(rows).join(F.broadcast(total))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("positives")
    f1 = F.when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    best = c.select(F.max_by(F.struct("score", p.alias("precision"), r.alias("recall"), f1.alias("f1")), F.struct(F.round(f1, 12), "score")).alias("b"))
    return best.select("b.*")


def at_k(rows: DataFrame, k: int, tie: str) -> DataFrame:
    """(k, precision, recall, lift) of the k largest scores, ties by ``tie``. A sort with a limit keeps k rows of each partition."""
    total = rows.agg(F.sum(F.col("y").cast("long")).alias("positives"), F.count(F.lit(1)).alias("n"))
    top = rows.orderBy(F.desc("score"), F.asc(tie)).limit(k).agg(F.sum(F.col("y").cast("long")).alias("hits"), F.count(F.lit(1)).alias("k"))
    both = top.join(F.broadcast(total))
    return both.select("k", (F.col("hits") / F.col("k")).alias("precision"), (F.col("hits") / F.col("positives")).alias("recall"), (F.col("hits") / F.col("k") / (F.col("positives") / F.col("n"))).alias("lift"))


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of (y, predicted), optionally by groups; rates without a denominator are 0."""
    y, p = F.col("y") == 1, F.col("predicted") == 1
    c = rows.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumn("accuracy", (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))
    c = c.withColumn("precision", z(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", z(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def percentile_rank(rows: DataFrame, score: str = "score") -> DataFrame:
    """``rows`` with the share of rows whose score isn't larger."""
    steps = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    upto = running(steps, [F.asc(score)], {"upto": F.col("n")})
    total = upto.agg(F.max("upto").alias("total"))  # one row
    return rows.join(upto.join(F.broadcast(total)).select(score, (F.col("upto") / F.col("total")).alias("percentile")), score)


def bootstrap_precision(rows: DataFrame, replicates: int = 100) -> DataFrame:
    """(low, high): 95 % interval of the share of positives among flagged rows, by Poisson bootstrap on hashed row ids."""
    u = lambda r: F.pmod(F.xxhash64("id", r), F.lit(1_000_000)) / 1_000_000
    weight = lambda x: F.when(x < 0.367879, 0).when(x < 0.735759, 1).when(x < 0.919699, 2).when(x < 0.981012, 3).otherwise(4)
    each = rows.where("predicted = 1").select("y", "id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("w", weight(u(F.col("r"))))
    share = each.groupBy("r").agg((F.sum(F.col("w") * F.col("y")) / F.nullif(F.sum("w"), F.lit(0))).alias("share"))
    return share.agg(F.percentile("share", F.lit(0.025)).alias("low"), F.percentile("share", F.lit(0.975)).alias("high"))
