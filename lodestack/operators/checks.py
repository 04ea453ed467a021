"""Constraints of the archive as queries: keys that repeat, references that lead nowhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def conflicting_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose deliveries differ in some column."""
    h = F.xxhash64(*columns)
    return df.groupBy(key).agg(F.count("*").alias("rows"), F.min(h).alias("__a"), F.max(h).alias("__b")).where("__a <> __b").select(key, "rows")


def dangling(df: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows that refer to a key that the target lacks; null refers to nothing."""
    return df.where(F.col(column).isNotNull()).join(target.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def report(violations: dict[str, DataFrame]) -> DataFrame:
    """check and number of violations."""
    out = None
    for name in sorted(violations):
        one = violations[name].agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
