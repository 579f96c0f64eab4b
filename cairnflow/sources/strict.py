"""The eight strict CSV files of a labelled transaction dataset: typed schemas, header checks, renames and validation in one run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Headers that arrive under other names than the canonical ones.
RENAMES = {"Time step": "time_step", "num_txs_as receiver": "num_txs_as_receiver"}
LABELS = (1, 2, 3)
LAST_STEP = 49


@dataclass(frozen=True)
class Spec:
    """A file: its leading columns, all of them or with further numbers up to ``width``; the key; and whether it has steps or labels."""

    file: str
    leading: tuple[tuple[str, str], ...]
    width: int
    key: tuple[str, ...] = ()
    step: str | None = None
    label: str | None = None

    def schema(self, header: list[str]) -> StructType:
        kinds = {"long": LongType(), "string": StringType()}
        fields = [StructField(n, kinds[t]) for n, t in self.leading]
        return StructType(fields + [StructField(n, DoubleType()) for n in header[len(fields) :]])


SPECS = {
    "txs_features": Spec("txs_features.csv", (("txId", "long"), ("Time step", "long")), 184, ("txId",), "time_step"),
    "txs_classes": Spec("txs_classes.csv", (("txId", "long"), ("class", "long")), 2, ("txId",), None, "class"),
    "wallets_features": Spec("wallets_features.csv", (("address", "string"), ("Time step", "long")), 57, ("address", "time_step"), "time_step"),
    "wallets_classes": Spec("wallets_classes.csv", (("address", "string"), ("class", "long")), 2, ("address",), None, "class"),
    "txs_edgelist": Spec("txs_edgelist.csv", (("txId1", "long"), ("txId2", "long")), 2),
    "addr_tx_edgelist": Spec("AddrTx_edgelist.csv", (("input_address", "string"), ("txId", "long")), 2),
    "tx_addr_edgelist": Spec("TxAddr_edgelist.csv", (("txId", "long"), ("output_address", "string")), 2),
    "addr_addr_edgelist": Spec("AddrAddr_edgelist.csv", (("input_address", "string"), ("output_address", "string")), 2),
}


def read_typed(spark: SparkSession, path: str, spec: Spec) -> DataFrame:
    """A CSV with the columns that its spec says, typed and renamed; a header that differs raises ValueError, as does a cell of the
    wrong type when it is read."""
    header = spark.read.option("header", True).csv(path).columns
    names = [n for n, _ in spec.leading]
    if len(header) != spec.width:
        raise ValueError(f"{spec.file}: expected {spec.width} columns, found {len(header)}")
    if header[: len(names)] != names:
        raise ValueError(f"{spec.file}: expected leading columns {names}, found {header[: len(names)]}")
    df = spark.read.option("header", True).option("mode", "FAILFAST").schema(spec.schema(header)).csv(path)
    return df.withColumnsRenamed({k: v for k, v in RENAMES.items() if k in header})


def problems(name: str, rows: DataFrame, spec: Spec) -> list[str]:
    """What is wrong with the rows of a file, from one aggregate: no rows, null or repeated keys, steps or labels outside their range."""
    key = list(spec.key) or rows.columns[:2]
    null = F.lit(False)
    for c in key:
        null = null | F.col(c).isNull()
    off_step = F.count_if(~F.coalesce(F.col(spec.step).between(1, LAST_STEP), F.lit(False))) if spec.step else F.lit(0)
    off_label = F.count_if(~F.coalesce(F.col(spec.label).isin(*LABELS), F.lit(False))) if spec.label else F.lit(0)
    per = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), off_step.alias("s"), off_label.alias("l"))
    z = lambda c: F.coalesce(c, F.lit(0))
    r = per.agg(z(F.sum("n")).alias("n"), z(F.sum(F.when(null, F.col("n")))).alias("nulls"), z(F.sum("n") - F.count(F.lit(1))).alias("again"), z(F.sum("s")).alias("steps"), z(F.sum("l")).alias("labels")).first()
    found = [f"{name}: no rows"] if not r["n"] else []
    found += [f"{name}: {r['nulls']} rows with null in {key}"] if r["nulls"] else []
    found += [f"{name}: {r['again']} rows repeat a key"] if spec.key and r["again"] else []
    found += [f"{name}: {r['steps']} steps outside 1 to {LAST_STEP}"] if r["steps"] else []
    return found + ([f"{name}: {r['labels']} labels outside {LABELS}"] if r["labels"] else [])


def ingest(spark: SparkSession, folder: str, specs: dict[str, Spec] = SPECS) -> dict[str, DataFrame]:
    """All files of the folder, read and validated; every problem is reported at once."""
    out, wrong = {}, []
    for name, spec in specs.items():
        try:
            out[name] = read_typed(spark, f"{folder}/{spec.file}", spec)
        except Exception as e:  # noqa: BLE001  reported below, all together
            wrong.append(f"{name}: {str(e).splitlines()[0]}")
    for name, rows in out.items():
        wrong += problems(name, rows, specs[name])
    if wrong:
        raise ValueError(f"{len(wrong)} problems: " + "; ".join(wrong))
    return out
