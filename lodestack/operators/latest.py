"""Latest state, best of group, ranks, streaks and waves: ordered work inside keys.

Every order ends in a unique column, so results don't depend on how rows are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import row_numbers


def latest_by_key(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row a key: the greatest by the given columns, which must be a total order.

    Nulls in ``by`` count as least.  The maximum is found by partial aggregation before the
    shuffle, so a key that holds a third of all rows costs one row a task.
    """
    order = F.struct(*[c.isNotNull().alias(f"n{i}") if j == 0 else c.alias(f"v{i}") for i, c in enumerate(by) for j in (0, 1)])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)  # Spark cuts groups before the shuffle


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Places in each key, from 0."""
    return row_numbers(df, keys, order, name).withColumn(name, (F.col(name) - 1).cast("int"))


def failure_streaks(attempts: DataFrame, key: str, order: list[Column], failed: Column, reset: Column, period: Column | None = None) -> DataFrame:
    """Adds ``streak``: consecutive failures up to and with each attempt.

    A failure adds one, a success with content resets, anything else leaves the count.  With
    a ``period``, which must rise with the order, windows are cut by it: what a period leaves
    is a number of failures and whether there was a reset, and periods carry on from those
    before.  A resource with a large part of all attempts is then spread over its periods.
    """
    clears = reset & ~failed
    d = attempts.withColumn("__f", F.when(failed, 1).otherwise(0)).withColumn("__r", F.when(clears, 1).otherwise(0)).withColumn("__t", period if period is not None else F.lit(0))
    w = Window.partitionBy(key, "__t").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__island", F.sum("__r").over(w))
    inner = Window.partitionBy(key, "__t", "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__own", F.sum("__f").over(inner))
    if period is None:
        return d.withColumn("streak", F.col("__own").cast("int")).drop("__f", "__r", "__t", "__island", "__own")
    # what each period leaves: failures after its last reset, and the islands of periods
    left = d.groupBy(key, "__t").agg(F.max_by(F.struct("__own", "__island"), F.struct(*order)).alias("__e"))
    left = left.select(key, "__t", F.col("__e.__own").alias("__n"), F.when(F.col("__e.__island") > 0, 1).otherwise(0).alias("__cleared"))
    by_time = Window.partitionBy(key).orderBy("__t")  # a row a period
    left = left.withColumn("__era", F.sum("__cleared").over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    left = left.withColumn("__sum", F.sum("__n").over(Window.partitionBy(key, "__era").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)))
    carried = left.select(F.col(key).alias("__key"), F.col("__t").alias("__time"), F.coalesce(F.lag("__sum").over(by_time), F.lit(0)).alias("__carry"))
    out = d.join(carried, F.col(key).eqNullSafe(F.col("__key")) & F.col("__t").eqNullSafe(F.col("__time")))
    streak = F.col("__own") + F.when(F.col("__island") == 0, F.col("__carry")).otherwise(0)
    return out.select(*attempts.columns, streak.cast("int").alias("streak"))


def first_stale_page(pages: DataFrame, query: str, page: str, has_news: Column, stop_after: int) -> DataFrame:
    """The page of each query at which so many pages in a row had nothing new; none if there is none."""
    w = Window.partitionBy(query).orderBy(page)
    island = F.sum(F.when(has_news, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    run = F.sum(F.when(has_news, 0).otherwise(1)).over(Window.partitionBy(query, "__island").orderBy(page).rowsBetween(Window.unboundedPreceding, 0))
    streaks = pages.withColumn("__island", island).withColumn("__run", run)
    return streaks.where(F.col("__run") >= stop_after).groupBy(query).agg(F.min(page).alias("stop_page"))


def waves(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds ``wave``: rows of one wave have different keys, and each comes in the first wave it can."""
    return row_numbers(df, [key], order, "wave").withColumn("wave", F.col("wave").cast("int"))


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in an order, with ``seq`` from 1; tasks keep n rows each."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("seq", F.row_number().over(Window.orderBy(*order)))  # n rows, a parameter


def shared_budget(first: DataFrame, second: DataFrame, order_first: list[Column], order_second: list[Column], n: int) -> DataFrame:
    """Up to n rows of two lists: the first has precedence, the second gets what is left.

    Both have the same columns; ``turn`` is 0 or 1.
    """
    a = first.orderBy(*order_first).limit(n).withColumn("turn", F.lit(0)).withColumn("__i", F.row_number().over(Window.orderBy(*order_first)))
    b = second.orderBy(*order_second).limit(n).withColumn("turn", F.lit(1)).withColumn("__i", F.row_number().over(Window.orderBy(*order_second)))
    return a.unionByName(b).orderBy("turn", "__i").limit(n).drop("__i")
