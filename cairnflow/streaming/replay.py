"""Streaming counterparts: hourly counts, first observations, bursts and the alert feed, over a file source of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnflow.durable import files_of


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Event files as a stream, a few files a batch; timestamps become instants, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "1 day", slide: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def bursts(events: DataFrame, gap: str = "10 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): sessions of events less than ``gap`` apart."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run all that is there through the stream into Parquet files, and stop; the result is read from the files, so nothing passes the
    driver. A new checkpoint folder is a reset. In complete mode each batch replaces the table; only the last one is read."""
    if mode == "complete":
        def put(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch:09d}")

        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        fs, at = files_of(stream.sparkSession, path)
        last = max(x.getPath().getName() for x in fs.listStatus(at))
        return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{last}")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class Feed:
    """Accumulates transactions batch by batch and activates edges once both their ends are there."""

    def __init__(self, spark: SparkSession, path: str, edges: DataFrame):
        self.spark, self.path, self.edges = spark, path, edges

    def inject(self, batch: DataFrame, epoch: int) -> None:
        """For foreachBatch. A batch replayed after a failure overwrites its own folder."""
        batch.write.mode("overwrite").parquet(f"{self.path}/tx/epoch={epoch}")

    def transactions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tx")

    def active_edges(self) -> DataFrame:
        ids = self.transactions().select(F.col("event_id").alias("id")).distinct()
        return self.edges.distinct().join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        stream.writeStream.foreachBatch(self.inject).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def status(self) -> DataFrame:
        return self.transactions().agg(F.count(F.lit(1)).alias("n_tx"), F.count_distinct("epoch").alias("n_batches"))


class Simulation:
    """Transactions enter in their order (tx_idx from 0), one or many at a time; edges become active with their ends.

    ``tx`` has (tx_idx, txid), ``edges`` (src, dst, relationship): addr_tx and tx_addr edges come with their transaction and bring their
    wallet, tx_tx edges need both transactions, addr_addr edges both wallets. What has entered is the step alone, a row appended to
    the state folder, so a step that is written twice counts once, and a reset is one more row."""

    STEPS = "seq bigint, step bigint"

    def __init__(self, spark: SparkSession, path: str, tx: DataFrame, edges: DataFrame):
        self.spark, self.path, self.tx, self.edges = spark, path, tx, edges.select("src", "dst", "relationship").distinct()
        self.total = tx.count()

    def step(self) -> int:
        """How many transactions have entered."""
        return self._last()[1]

    def _last(self) -> tuple[int, int]:
        fs, at = files_of(self.spark, self.path)
        if not fs.exists(at):
            return -1, 0
        row = self.spark.read.schema(self.STEPS).parquet(self.path).orderBy(F.desc("seq")).first()
        return (row["seq"], row["step"]) if row else (-1, 0)

    def _put(self, step: int) -> None:
        self.spark.createDataFrame([(self._last()[0] + 1, step)], self.STEPS).coalesce(1).write.mode("append").parquet(self.path)

    def inject_batch(self, n: int) -> DataFrame:
        """Let the next ``n`` transactions enter (as many as there are) and return them."""
        if n < 1:
            raise ValueError("a batch holds one transaction at least")
        at = self.step()
        to = min(self.total, at + n)
        if to > at:
            self._put(to)
        return self.tx.where((F.col("tx_idx") >= at) & (F.col("tx_idx") < to))

    def inject_next(self) -> DataFrame:
        return self.inject_batch(1)

    def inject(self, n: int = 1) -> DataFrame:
        """A batch, or a single step for one."""
        return self.inject_batch(n) if n > 1 else self.inject_next()

    def reset(self, mode: str = "baseline") -> DataFrame:
        """Back to the first transaction ('baseline'), or on to all of them ('full'); returns the status."""
        if mode not in ("baseline", "full"):
            raise ValueError("mode is 'baseline' or 'full'")
        self._put(self.total if mode == "full" else min(1, self.total))
        return self.status()

    def transactions(self) -> DataFrame:
        return self.tx.where(F.col("tx_idx") < self.step())

    def active_edges(self) -> DataFrame:
        """(src, dst, relationship), each once."""
        e, ids = self.edges, self.transactions().select(F.col("txid").cast("string").alias("id")).distinct()
        src, dst = ids.withColumnRenamed("id", "src"), ids.withColumnRenamed("id", "dst")
        of = lambda r: e.where(F.col("relationship") == r)
        addr_tx, tx_addr = of("addr_tx").join(dst, "dst", "left_semi"), of("tx_addr").join(src, "src", "left_semi")
        wallets = addr_tx.select(F.col("src").alias("id")).union(tx_addr.select(F.col("dst").alias("id"))).distinct()
        tx_tx = of("tx_tx").join(src, "src", "left_semi").join(dst, "dst", "left_semi")
        addr_addr = of("addr_addr").join(wallets.withColumnRenamed("id", "src"), "src", "left_semi").join(wallets.withColumnRenamed("id", "dst"), "dst", "left_semi")
        cols = ["src", "dst", "relationship"]
        return addr_tx.select(cols).unionByName(tx_addr.select(cols)).unionByName(tx_tx.select(cols)).unionByName(addr_addr.select(cols))

    def wallets(self) -> DataFrame:
        e = self.active_edges()
        return e.where("relationship = 'addr_tx'").select(F.col("src").alias("wallet")).union(e.where("relationship = 'tx_addr'").select(F.col("dst").alias("wallet"))).distinct()

    def status(self) -> DataFrame:
        """(current_step, total_steps, can_inject_next, last_txid, next_txid, total_transactions, total_wallets, total_edges)."""
        at = self.step()
        ends = self.tx.where(F.col("tx_idx").isin(at - 1, at)).agg(F.max(F.when(F.col("tx_idx") == at - 1, F.col("txid"))).alias("last_txid"), F.max(F.when(F.col("tx_idx") == at, F.col("txid"))).alias("next_txid"))
        n, w = self.transactions().agg(F.count(F.lit(1)).alias("total_transactions")), self.wallets().agg(F.count(F.lit(1)).alias("total_wallets"))
        e = self.active_edges().agg(F.count(F.lit(1)).alias("total_edges"))
        one = ends.join(F.broadcast(n)).join(F.broadcast(w)).join(F.broadcast(e))  # one row each
        return one.select(F.lit(at).cast("bigint").alias("current_step"), F.lit(self.total).cast("bigint").alias("total_steps"), F.lit(at < self.total).alias("can_inject_next"), "last_txid", "next_txid", "total_transactions", "total_wallets", "total_edges")
