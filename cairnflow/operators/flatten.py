"""Flattening nested transaction rows to relations and nesting them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, name: str, bucket: Column, order: list[str]) -> DataFrame:
    """A dense index from 0 in the order of ``order``, whose leading column ``bucket`` must follow.

    Rows are numbered within each bucket and offset by the rows of the buckets before. Only the table of bucket sizes is met in
    one place, so the rows themselves stay spread over the buckets (days, say)."""
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return rows.join(offsets, "__bucket").withColumn(name, F.col("__offset") + rank - 1).drop("__bucket", "__offset")


def first_observations(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The earliest row of each key; the others remain observations of it."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(ts, tie))).where("__rn = 1").drop("__rn")


def explode_sides(rows: DataFrame, key: str, addresses: str, amounts: str) -> DataFrame:
    """(key, pos, addr, amount) from two parallel arrays."""
    zipped = F.arrays_zip(F.col(addresses).alias("addr"), F.col(amounts).alias("amount"))
    return rows.select(key, F.posexplode(zipped).alias("pos", "x")).select(key, "pos", F.col("x.addr").alias("addr"), F.col("x.amount").alias("amount"))


def nest_sides(sides: DataFrame, key: str, addresses: str, amounts: str) -> DataFrame:
    """The arrays again, in the order of pos; a transaction's own lists bound the group."""
    items = F.array_sort(F.collect_list(F.struct("pos", "addr", "amount")))
    return sides.groupBy(key).agg(items.alias("x")).select(key, F.transform("x", lambda i: i["addr"]).alias(addresses), F.transform("x", lambda i: i["amount"]).alias(amounts))


def derive_fee(fee: Column, n_in: Column, total_in: Column, total_out: Column) -> Column:
    """A missing fee is 0 without inputs, else what the inputs exceed the outputs by, 0 at least."""
    return F.coalesce(fee, F.when(n_in == 0, 0.0).otherwise(F.greatest(total_in - total_out, F.lit(0.0))))


def fingerprint(rows: DataFrame, bucket: Column, *parts: Column) -> DataFrame:
    """(bucket, n, digest): SHA-256 over the count and the sum of 48-bit hashes of each bucket's rows. The sum doesn't depend on the
    order of rows and is combined before the shuffle, so a bucket of any size costs one row a task."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("total"))
    return sums.select("bucket", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("total").cast("string")), 256).alias("digest"))
