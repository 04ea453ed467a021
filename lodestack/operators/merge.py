"""Keyed merges of latest-state tables: what a batch inserts, changes, leaves and removes.

Plain files have no MERGE, so a merge is a join on the key, an action for each key, and a new
table.  All are idempotent: a batch merged again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest_by_key


def one_per_key(batch: DataFrame, keys: list[str], seq: Column, last_wins: bool = True) -> DataFrame:
    """A batch with one row a key, the last (or first) by ``seq``, a unique order."""
    return latest_by_key(batch, keys, [seq if last_wins else -seq])


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], compare: list[str], delete_missing: bool = False) -> DataFrame:
    """The merged table with ``action``: insert, update, unchanged, keep or delete.

    ``target`` and ``batch`` have the same columns and one row a key.  A row is updated if
    any of the compared columns differs, nulls counting as values.  ``delete_missing`` marks
    rows whose key the batch lacks, as a full refresh does; else they are kept.
    """
    t = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("__old"))
    b = batch.select(*keys, F.struct(*[c for c in batch.columns if c not in keys]).alias("__new"))
    both = t.join(b, keys, "full")
    old, new = F.col("__old"), F.col("__new")
    same = F.lit(True)
    for c in compare:
        same = same & old[c].eqNullSafe(new[c])
    action = (
        F.when(old.isNull(), "insert")
        .when(new.isNull(), "delete" if delete_missing else "keep")
        .when(same, "unchanged")
        .otherwise("update")
    )
    rest = [c for c in target.columns if c not in keys]
    pick = [F.when(action.isin("insert", "update"), new[c]).otherwise(old[c]).alias(c) for c in rest]
    return both.select(*keys, *pick, action.alias("action"))


def carry_over(target: DataFrame, batch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A batch in which nulls of some columns are filled from the target, as when a count was not asked for."""
    old = target.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    out = batch.join(old, keys, "left")
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in batch.columns])


def put_blobs(store: DataFrame, batch: DataFrame, content: str, seq: Column, hashed: bool = False) -> DataFrame:
    """Blobs of a batch that the store lacks, by hash; of equal ones the first by ``seq`` stays.

    With ``hashed``, ``content`` holds the hash, so that contents need not be moved to be compared.
    """
    named = batch.withColumn("sha256", F.col(content) if hashed else F.sha2(F.col(content), 256))
    rest = [c for c in named.columns if c != "sha256"]
    first = named.groupBy("sha256").agg(F.min_by(F.struct(*rest), seq).alias("__b")).select("sha256", "__b.*")
    return first.join(store.select("sha256"), "sha256", "left_anti")


def orphans(blobs: DataFrame, key: str, references: list[tuple[DataFrame, str]]) -> DataFrame:
    """Blobs that nothing refers to; null references refer to nothing."""
    used = None
    for df, column in references:
        ids = df.select(F.col(column).alias(key)).where(F.col(key).isNotNull())
        used = ids if used is None else used.unionByName(ids)
    return blobs.join(used.distinct(), key, "left_anti")


def replace_children(children: DataFrame, batch: DataFrame, parent: str, value: str, order: list[Column]) -> DataFrame:
    """Child rows (parent, value, position) after the batch replaced those of its parents.

    Blank values are dropped, of equal ones in a parent the first stays, and positions count
    from 0.  Parents that the batch lacks keep their children.
    """
    rows = batch.withColumn(value, F.trim(value)).where(F.coalesce(value, F.lit("")) != "")
    w = Window.partitionBy(parent, value).orderBy(*order)
    first = rows.withColumn("__i", F.row_number().over(w)).where("__i = 1")
    new = first.withColumn("position", (F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1).cast("int")).select(parent, value, "position")
    kept = children.select(parent, value, "position").join(batch.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(new)
