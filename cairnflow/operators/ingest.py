"""From raw rows to clean ones: aliases, parsing, drop reasons, unit detection, validation, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.functions.scalars import parse_list, parse_numbers, parse_time

REQUIRED = ("timestamp", "txid", "input_addresses", "output_addresses", "input_amounts", "output_amounts")
OPTIONAL = {"src_ip": "", "dst_ip": "", "src_port": None, "dst_port": None, "fee": None, "script_type": "", "geo_country": "", "asn": None}
#: Names under which columns arrive.
ALIASES = {
    "time": "timestamp", "ts": "timestamp", "datetime": "timestamp", "block_time": "timestamp", "first_seen": "timestamp", "date": "timestamp",
    "tx_id": "txid", "tx_hash": "txid", "txhash": "txid", "hash": "txid", "transaction_id": "txid",
    "source_ip": "src_ip", "src_address": "src_ip", "destination_ip": "dst_ip", "dest_ip": "dst_ip", "source_port": "src_port", "destination_port": "dst_port", "dest_port": "dst_port",
    "inputs": "input_addresses", "input_addrs": "input_addresses", "input_wallets": "input_addresses", "input_address": "input_addresses",
    "outputs": "output_addresses", "output_addrs": "output_addresses", "output_wallets": "output_addresses", "output_address": "output_addresses",
    "input_values": "input_amounts", "output_values": "output_amounts", "fee_btc": "fee", "fees": "fee", "script": "script_type",
    "country": "geo_country", "geo": "geo_country", "as_number": "asn",
}
#: Epochs whose median is above this are in milliseconds.
MILLISECONDS_ABOVE = 1e11


def canonical(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns under their canonical names, and the renames made. An alias gives way to a column that has the name already. Missing
    required columns raise; missing optional ones are filled."""
    names, renames = {c: c.strip().lower() for c in rows.columns}, {}
    taken = set(names.values())
    for c, n in list(names.items()):
        target = ALIASES.get(n)
        if target and target not in taken:
            names[c], renames[c] = target, target
            taken.add(target)
    out = rows.toDF(*[names[c] for c in rows.columns])
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c, default in OPTIONAL.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(default).cast("string"))
    return out, renames


def epoch_unit(rows: DataFrame, column: str = "timestamp") -> float:
    """Parts of a second in the column's epochs, 1 or 1000: one unit for the whole column, as its median says."""
    median = rows.agg(F.percentile_approx(F.abs(F.col(column).try_cast("double")), F.lit(0.5), F.lit(10_000)).alias("m")).first()["m"]
    return 1000.0 if median is not None and median > MILLISECONDS_ABOVE else 1.0


def parse_rows(rows: DataFrame, unit: float | None = None) -> DataFrame:
    """Raw string rows with parsed cells and drop_reason: the first check that fails, null for rows that stay. ``unit`` is that of the
    column's epochs (``epoch_unit``); without one, each epoch tells its own."""
    out = rows.withColumns({
        "ts": parse_time(F.col("timestamp"), unit),
        "ia": parse_list(F.col("input_addresses")), "oa": parse_list(F.col("output_addresses")),
        "iv": parse_numbers(F.col("input_amounts")), "ov": parse_numbers(F.col("output_amounts")),
    })
    bad = F.col("ia").isNull() | F.col("oa").isNull() | F.col("iv").isNull() | F.col("ov").isNull()
    reason = (
        F.when(F.col("ts").isNull(), "unparseable_timestamp").when(F.trim(F.coalesce("txid", F.lit(""))) == "", "missing_txid").when(bad, "malformed_list_cell")
        .when((F.size("ia") != F.size("iv")) | (F.size("oa") != F.size("ov")), "address_amount_length_mismatch").when(F.size("oa") == 0, "no_outputs")
        .when(F.exists("iv", lambda x: x < 0) | F.exists("ov", lambda x: x < 0), "negative_amount")
    )
    return out.withColumn("drop_reason", reason)


def drop_reasons(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def detect_unit(rows: DataFrame, order: str, first: int = 5000, limit: float = 1e6) -> DataFrame:
    """(typical, small_units): median of the positive output amounts among the first rows, and whether amounts look like smallest units."""
    head = rows.orderBy(order).limit(first).select(F.explode("output_amounts").alias("x")).where("x > 0")
    return head.agg(F.percentile("x", F.lit(0.5)).alias("typical")).select("typical", (F.col("typical") > limit).alias("small_units"))


def clean_script(script: F.Column) -> F.Column:
    return F.coalesce(F.nullif(F.upper(F.trim(script)), F.lit("")), F.lit("UNKNOWN"))


def validate(rows: DataFrame, key: list[str], sets: dict[str, list], ranges: dict[str, tuple[float, float]], parents: DataFrame) -> DataFrame:
    """One row of counts: rows, null keys, repeated keys, values outside sets and ranges, rows without a parent."""
    outside_set = F.lit(False)
    for c, values in sets.items():
        outside_set = outside_set | ~F.col(c).isin(values)
    outside_range = F.lit(False)
    for c, (low, high) in ranges.items():
        outside_range = outside_range | ~F.col(c).between(low, high)
    per_key = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(outside_set).alias("s"), F.count_if(outside_range).alias("r"))
    null = F.col(key[0]).isNull()
    sums = per_key.agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).cast("bigint").alias("null_keys"), (F.sum("n") - F.count(F.lit(1))).alias("repeated_keys"), F.sum("s").alias("outside_set"), F.sum("r").alias("outside_range")
    )
    on = parents.columns
    dangling = rows.join(parents, on, "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    return sums.join(F.broadcast(dangling))


def impute_medians(rows: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the medians of the training rows."""
    medians = train.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    return rows.fillna({c: medians[c] for c in columns if medians[c] is not None})


def edges_of(rows: DataFrame, src: str, dst: str, relationship: str, provenance: str = "import", confidence: float = 1.0) -> DataFrame:
    return rows.select(
        F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(relationship).alias("relationship"), F.lit(False).alias("is_synthetic"), F.lit(confidence).alias("confidence"), F.lit(provenance).alias("provenance")
    )
