"""Reading raw transaction files and writing them again."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

SUFFIXES = (".csv", ".tsv", ".txt", ".jsonl", ".ndjson", ".json", ".xml", ".parquet")
WRAPPERS = ("transactions", "records", "data", "items")


def as_strings(df: DataFrame) -> DataFrame:
    """Scalars as strings and lists as JSON strings, so that all formats meet the same parser."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StructType) and len(f.dataType.fields) == 1 and isinstance(f.dataType.fields[0].dataType, ArrayType):
            c = F.to_json(c[f.dataType.fields[0].name])
        elif isinstance(f.dataType, (ArrayType, StructType)):
            c = F.to_json(c)
        elif not isinstance(f.dataType, StringType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


_strings = as_strings


def read_raw(spark: SparkSession, path: str, row_tag: str = "transaction") -> DataFrame:
    """Rows of a raw file as strings. The suffix names the format; an unknown one raises ValueError, a missing path Spark's error."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".tsv", ".txt"):
        return spark.read.option("header", True).option("sep", "\t" if suffix == ".tsv" else ",").option("quote", '"').option("escape", '"').csv(path)
    if suffix in (".jsonl", ".ndjson"):
        return as_strings(spark.read.json(path))
    if suffix == ".json":
        df = spark.read.option("multiLine", True).json(path)
        wrapper = next((w for w in WRAPPERS if w in df.columns and isinstance(df.schema[w].dataType, ArrayType)), None)
        return as_strings(df.select(F.explode(wrapper).alias("x")).select("x.*") if wrapper else df)
    if suffix == ".xml":
        return as_strings(spark.read.format("xml").option("rowTag", row_tag).load(path))
    if suffix == ".parquet":
        return as_strings(spark.read.parquet(path))
    raise ValueError(f"unsupported file type {suffix or path!r}; supported: {', '.join(SUFFIXES)}")


def read_strict(spark: SparkSession, path: str, columns: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """A CSV whose header must be exactly ``columns``."""
    df = spark.read.option("header", True).csv(path)
    if df.columns != columns:
        raise ValueError(f"{path}: expected columns {columns}, found {df.columns}")
    return df.withColumnsRenamed(renames or {})


def read_all(spark: SparkSession, folder: str, specs: dict[str, list[str]]) -> dict[str, DataFrame]:
    """All files of ``specs`` (name: header); every problem is reported at once."""
    out, problems = {}, []
    for name, columns in specs.items():
        try:
            out[name] = read_strict(spark, f"{folder}/{name}.csv", columns)
        except Exception as e:  # noqa: BLE001  reported below, all together
            problems.append(f"{name}: {str(e).splitlines()[0]}")
    if problems:
        raise ValueError("; ".join(problems))
    return out


def read_table_or_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file that is a list of records (a row each) or one record (one row); types as read."""
    return spark.read.option("multiLine", True).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """An XML file as a table: a row for each ``row_tag`` element, types as read."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file without blanks and comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, country) of a CSV of IPv4 ranges or of CIDR blocks (network, country); other rows go."""
    from cairnflow.functions.scalars import ip_to_int

    raw = spark.read.csv(path)
    first = F.col(raw.columns[0])
    if len(raw.columns) >= 3:
        rows = raw.select(ip_to_int(first).alias("start"), ip_to_int(F.col(raw.columns[1])).alias("end"), F.col(raw.columns[2]).alias("country"))
    else:
        base, bits = ip_to_int(F.split(first, "/")[0]), F.split(first, "/")[1].try_cast("int")
        rows = raw.where(first.contains("/")).select(base.alias("start"), (base + F.pow(F.lit(2), 32 - bits).cast("long") - 1).alias("end"), F.col(raw.columns[1]).alias("country"))
    return rows.where((F.col("start") >= 0) & (F.col("end") >= F.col("start")))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with lists as JSON."""
    cols = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*cols).write.option("header", True).option("quote", '"').option("escape", '"').mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_xml(rows: DataFrame, path: str) -> None:
    rows.write.format("xml").option("rootTag", "transactions").option("rowTag", "transaction").mode("overwrite").save(path)


def write_truth(rows: DataFrame, path: str) -> None:
    """CSV of the planted labels (addr, owner, illicit, scenario, campaign) of generated rows; a frame without them is refused."""
    missing = {"addr", "illicit", "scenario"} - set(rows.columns)
    if missing:
        raise ValueError(f"no ground truth: {sorted(missing)} are missing")
    write_csv(rows, path)


def write_synthetic(rows: DataFrame, path: str) -> None:
    """CSV of generated observations; rows not marked as synthetic are refused."""
    if rows.where(~F.coalesce("is_synthetic", F.lit(False))).limit(1).count():
        raise ValueError("only synthetic rows may be exported")
    write_csv(rows, path)
