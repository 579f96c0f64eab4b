"""What the corpus operators share: reading tables, durable intermediate tables, Arrow scans over whole texts, rows by their place
in the files, and joins in which one key may hold most rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.durable import release, run_dir, stash
from cairnflow.operators.skew import join_hot, salts

__all__ = ["field", "held_out", "join_hot", "keep_rows", "labelled_sample", "read", "release", "rows_of", "run_dir", "salts", "scan_texts", "stash", "tie_of"]

#: Rows that are Python objects at a time. The session's ``spark.sql.execution.arrow.maxBytesPerBatch`` (64 MB unless set) bounds
#: the bytes of the Arrow batch that they are cut from, however long the texts are.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def field(name: str, of: str = "own") -> Column:
    """A column that ``rows_of`` has packed."""
    return F.col(of)[name]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _of_files(df: DataFrame) -> bool:
    """Whether rows are rows of files, perhaps filtered and projected: then their place in the files tells them apart."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def rows_of(docs: DataFrame) -> DataFrame:
    """(own, row): the columns of ``docs`` packed into a struct, so that no name clashes with an operator's, and a key (128 bits of
    file and place in the file) that tells each row from every other and is the same whenever it is computed. Decisions are made on
    keys alone and carried back by them; as no two rows share one, no task gets more than its part, whatever the texts are. Rows
    that don't come straight from Parquet files are written first."""

    def keyed(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        key = F.unhex(F.md5(F.concat_ws(":", at["file_path"], at["row_index"].cast("string"))))
        return df.select(F.struct(*[df[_quoted(c)] for c in df.columns]).alias("own"), key.alias("row"))

    if _of_files(docs):
        try:
            return keyed(docs)
        except AnalysisException:  # files that don't tell a row's place, as CSV
            pass
    return keyed(stash(docs, "rows"))


def tie_of(docs: DataFrame) -> Column:
    """A hash of all columns of a packed row of ``docs`` that can be hashed; it orders rows that agree in id and text."""
    plain = [f.name for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    return F.xxhash64(F.lit(0), *[field(c) for c in plain])


def keep_rows(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The own columns of ``rows`` (of ``rows_of``) whose key isn't in ``dropped`` (row). A merge join whatever the sizes, so that the
    plan, and what it costs a row, is the same for a gigabyte and for a hundred terabytes."""
    return rows.join(dropped.hint("merge"), "row", "left_anti").select("own.*")


def scan_texts(
    df: DataFrame, schema: str, fn: Callable[[Iterator[dict]], Iterator[dict]], batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Run ``fn`` over the rows of each partition. ``fn`` gets batches as {column: list} and yields batches likewise.

    Arrow moves the data; ``fn`` sees ``batch_rows`` rows at most at a time, so memory doesn't grow with a partition.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict]:
            for b in batches:
                for at in range(0, b.num_rows, batch_rows):
                    part = b.slice(at, batch_rows)
                    yield {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}

        for out in fn(columns()):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that no classifier learns from: crc32 of the id as text divides by ``folds``. A null id is never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int) -> DataFrame | None:
    """``docs`` with y for the labelled rows to learn from, about ``max_rows`` of them at most, chosen by a hash of the id (all,
    where there are fewer); None without any. Of several labels of one id the largest counts."""
    y = labels.where(~held_out(F.col("doc_id")) & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("double").alias("y"))
    y = stash(y, "labels")
    total = y.count()
    if not total:
        return None
    if total > max_rows:
        y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")  # max_rows bounds the broadcast
