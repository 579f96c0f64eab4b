"""Running totals over a whole table without a task that sees all rows.

Rows are dealt by range, so that parts follow each other in the order, and written, so that they stay where they are. Each part is
summed up inside and offset by the totals of the parts before; only those totals, one row a part, meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.durable import stash


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``rows`` with the running total, own row included, of each column of ``sums`` in the order of ``order``. Rows that are equal in
    the order are added one by one, so their totals depend on where they lie; make the order total if that matters. A null
    adds nothing; an empty table gives an empty result."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(rows.withColumns({f"__{k}": c for k, c in sums.items()}).repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = dealt.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in sums])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__part", *[F.sum(f"__{k}").over(earlier).alias(f"__before_{k}") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), "__part")  # a row for each part
    total = {k: F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) + F.coalesce(F.col(f"__before_{k}"), F.lit(0)) for k in sums}
    return out.withColumns(total).select(*rows.columns, *sums)
