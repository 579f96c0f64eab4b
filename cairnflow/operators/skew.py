"""Joins with facts about a key when one key may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are dealt (bits of a long).
SALTS = 64


def salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by, F.lit(41)), F.lit(SALTS)).cast("int")


def salts(by: str) -> Column:
    """Aggregate: the salts that a key's rows have, as a set of bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), salt(by))).alias("salts")


def join_hot(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``facts`` by ``key``, though one key may hold most rows: rows are dealt by key and a salt from ``by``.
    ``facts`` has one narrow row for each key with ``salts(by)`` of its rows, and goes where these say that rows are."""
    here = F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("salts"), i) == 1))
    spread = facts.withColumn("salt", here).drop("salts")
    return rows.withColumn("salt", salt(by)).join(spread, [key, "salt"]).drop("salt")
