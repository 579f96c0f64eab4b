"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are digested; of equal texts in a batch the row with the largest id
stays; the rows whose digest the index lacks (a sort-merge anti join, for which the index needs no shuffle) are appended. The index
keeps the name of the batch that brought a digest, so a batch that is added again under its name, after a failure between the
append and the use of the result, finds its own digests new again and gives the same result.

Defined cases: a null text counts as empty; a null id is smaller than any id; of rows repeated with the same id and text one row
stays (the largest hash of all its columns, then any), and every one of them names it; an empty table gives an empty result and
leaves the index as it was; extra columns are carried whatever their names, but ``add`` replaces those named like its results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm.common import field, join_hot, keep_rows, read, rows_of, run_dir, salts, stash, tie_of


def digest_of(text: F.Column) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


class DigestIndex:
    """A table (digest, keep_id, group_size, batch) in ``buckets`` buckets, each sorted by digest, at ``path``.

    The path makes the index last beyond a session: opening the same path again registers its files anew.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, id_type: str = "bigint", buckets: int = 64):
        self.spark, self.name, self.path = spark, name, path
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id {id_type}, group_size BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.buckets = buckets

    def table(self) -> DataFrame:
        self.spark.sql(f"REFRESH TABLE {self.name}")
        return self.spark.table(self.name)

    def decide(self, rows: DataFrame, batch: str | None = None) -> DataFrame:
        """Append what is new among ``rows`` (id, tie, digest, row) and return (row, id, digest, keep_id, group_size, kept)."""
        batch = batch or uuid.uuid4().hex
        rows = stash(rows, "digests")
        best = rows.groupBy("digest").agg(F.max(F.struct(F.col("id").alias("keep_id"), "tie", "row")).alias("best"), F.count(F.lit(1)).alias("n"), salts("row"))
        best = stash(best.select("digest", "best.keep_id", F.col("best.row").alias("keep_row"), "n", "salts"), "winners")
        others, mine = self.table().where(F.col("batch") != batch), self.table().where(F.col("batch") == batch)
        new = stash(best.join(others.select("digest").hint("merge"), "digest", "left_anti"), "new")
        stored = others.select("digest", F.col("keep_id").alias("stored_id"), F.col("group_size").alias("stored")).hint("merge")
        known = best.join(new.select("digest"), "digest", "left_anti").join(stored, "digest")
        known = known.select("digest", F.col("stored_id").alias("keep_id"), F.lit(None).cast("binary").alias("keep_row"), (F.col("n") + F.col("stored")).alias("n"), "salts")
        known = stash(known, "known")
        fresh = new.join(mine.select("digest").hint("merge"), "digest", "left_anti")
        (fresh.select("digest", "keep_id", F.col("n").alias("group_size"), F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        facts = known.unionByName(new).withColumnRenamed("n", "group_size")
        out = join_hot(rows, facts, "digest", "row")
        return out.select("row", "id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Append what is new and return one row per row of ``docs``, dropped ones too: the columns of ``docs`` except the
        text, digest, keep_id (the row that stays in the index), group_size (rows of this batch, and those the index counted when it
        took the text in) and kept. Name the ``batch`` to be able to add it again after a failure; without a name it is a new one."""
        rows = rows_of(docs)
        seen = self.decide(_digested(rows, docs, id_col, text_col), batch)
        ours = ["digest", "keep_id", "group_size", "kept"]
        gone = {text_col.lower(), *ours}
        rest = [c for c in docs.columns if c.lower() not in gone]
        if rest == [id_col]:
            return seen.select(F.col("id").alias(id_col), *ours)
        packed = rows.select("row", F.struct(*[field(c).alias(c) for c in rest]).alias("own"))
        return packed.join(seen, "row").select("own.*", *ours)


def _digested(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(field(id_col).alias("id"), tie_of(docs).alias("tie"), digest_of(field(text_col)).alias("digest"), "row")


def distinct_rows(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose texts are new to ``index``, one of each text, with their own columns; they are added to the index.
    Null texts, null ids, repeated rows and empty tables are treated as by ``add``."""
    rows = rows_of(docs)
    seen = index.decide(_digested(rows, docs, id_col, text_col), batch)
    return keep_rows(rows, stash(seen.where(~F.col("kept")).select("row"), "dropped"))


def fresh_index(spark: SparkSession, id_type: str = "bigint", buckets: int = 64) -> DigestIndex:
    """An index that goes when the driver ends."""
    tag = uuid.uuid4().hex
    return DigestIndex(spark, f"digests_{tag}", f"{run_dir(spark)}/index-{tag}", id_type, buckets)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = fresh_index(spark).add(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, digest AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents)
WINDOW g AS (PARTITION BY digest)
"""
