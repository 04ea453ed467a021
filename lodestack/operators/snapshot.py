"""Snapshots of tables: a manifest of counts and hashes, and a copy checked against it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows and a hash of their contents that doesn't depend on order."""
    cols = []
    for name, kind in sorted(df.dtypes):
        c = F.col(f"`{name}`")
        cols.append(F.to_json(F.struct(F.sort_array(F.map_entries(c)).alias("m"))) if kind.startswith("map") else c)
    h = F.xxhash64(*cols)
    part = F.pmod(h, F.lit(1 << 52)).cast("decimal(28,0)")  # sums of longs overflow at some 4,000 rows
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("content"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, content of every table."""
    out = None
    for name in sorted(tables):
        one = fingerprint(tables[name]).select(F.lit(name).alias("table"), "rows", "content")
        out = one if out is None else out.unionByName(one)
    return out


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Copies of all tables with their manifest; the folder must not exist yet."""
    if "://" not in folder and Path(folder).exists():
        raise FileExistsError(folder)
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    told, copied = (sorted(map(tuple, manifest(t).collect())) for t in (tables, {n: _spark(tables).read.parquet(f"{folder}/{n}") for n in tables}))  # one row a table
    if told != copied:
        raise ValueError(f"the copy in {folder} differs from its source: {sorted(set(told) ^ set(copied))}")
    spark = _spark(tables)
    spark.createDataFrame(copied, "table string, rows long, content string").coalesce(1).write.parquet(f"{folder}/_manifest")


def _spark(tables: dict[str, DataFrame]) -> SparkSession:
    return next(iter(tables.values())).sparkSession


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, after their manifest has been checked."""
    told = {r["table"]: (r["rows"], r["content"]) for r in spark.read.parquet(f"{folder}/_manifest").collect()}  # one row a table
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in told}
    for r in manifest(tables).collect():
        if told[r["table"]] != (r["rows"], r["content"]):
            raise ValueError(f"table {r['table']} differs from the manifest")
    return tables
