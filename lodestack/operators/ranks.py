"""Row numbers inside keys, also where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint

#: Rows of one key that one task sorts; beyond it the key is spread over tasks.
HOT_ROWS = 2_000_000


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds numbers from 1 inside each key, by a total order.

    Keys of up to ``hot_rows`` rows are numbered by a window.  If there is a larger one, rows
    are range-partitioned by key and order, which cuts it into pieces; each piece is numbered
    by itself and starts where the ones before it end.  The result is the same.
    """
    largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= hot_rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__p", F.spark_partition_id())
    spread = checkpoint(spread)  # the ranges are drawn from a sample: a second run might cut otherwise
    sizes = spread.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__p")  # a row a partition
    starts = sizes.select(*keys, "__p", (F.sum("__n").over(before) - F.col("__n")).alias("__start"))
    starts = starts.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)}).withColumnRenamed("__p", "__q")
    own = Window.partitionBy(*keys, "__p").orderBy(*order)
    same = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = spread.withColumn("__i", F.row_number().over(own)).join(starts, same)
    return out.select(*df.columns, (F.col("__i") + F.col("__start")).cast("long").alias(name))
