"""Lookups of counts and values that may be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(df: DataFrame, values: DataFrame, key: str, column: str, default) -> DataFrame:
    """Adds a looked-up column; keys that the lookup lacks, or holds as null, get the default.

    Should the lookup hold a key more than once, its greatest value counts.
    """
    one = values.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(column).alias(column))
    return df.join(one, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def star_total(plain: Column, coloured: Column) -> Column:
    """Stars of a response: each plain and coloured star counts ``count`` times, at least once.

    ``plain`` is array<struct<count>>, ``coloured`` array<struct<stars: array<struct<count>>>>.
    """
    one = lambda acc, s: acc + F.greatest(F.coalesce(s["count"], F.lit(1)), F.lit(1)).cast("long")
    zero = F.lit(0).cast("long")
    a = F.coalesce(F.aggregate(plain, zero, one), zero)
    b = F.coalesce(F.aggregate(F.flatten(F.transform(coloured, lambda g: g["stars"])), zero, one), zero)
    return a + b


def changed_counts(batch: DataFrame, state: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose count differs from the known one, or was not known: those worth a closer look."""
    old = state.select(key, F.col(column).alias("__old"))
    return batch.join(old, key, "left").where(F.col(column).isNull() | ~F.col(column).eqNullSafe(F.col("__old"))).drop("__old")


def outcome_report(actions: DataFrame, by: list[str], action: str = "action") -> DataFrame:
    """Counts of each outcome in one row a group."""
    kinds = ("insert", "update", "unchanged", "keep", "delete")
    return actions.groupBy(*by).agg(F.count("*").alias("processed"), *[F.count_if(F.col(action) == k).alias(k) for k in kinds])


def ratio(df: DataFrame, by: list[str], part: Column, whole: Column) -> DataFrame:
    """Ratio of sums over the valid records of each group, and their number.

    Records without a positive whole or with a null part don't count; none give a null ratio.
    """
    ok = df.where((whole > 0) & part.isNotNull())
    return ok.groupBy(*by).agg(F.try_divide(F.sum(part), F.sum(whole)).alias("ratio"), F.count("*").alias("records"))
