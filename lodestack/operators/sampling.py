"""Deterministic samples: sizes, allocation to strata by largest remainders, even spacing."""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import row_numbers

#: A percentage asks for at least so many rows.
LEAST = 20


def sample_size(value: str, population: int) -> int:
    """Rows that ``"10%"`` or ``"25"`` ask for; a percentage is rounded up and at least LEAST."""
    text = str(value).strip()
    try:
        if text.endswith("%"):
            share = Decimal(text[:-1].strip())
            if not share.is_finite() or not 0 <= share <= 100:
                raise ValueError(f"no percentage: {value}")
            if share == 0:
                return 0
            n = int((share * population / 100).to_integral_value(ROUND_CEILING))
            return min(population, max(n, min(LEAST, population)))
        n = int(text)
    except InvalidOperation as e:
        raise ValueError(f"no sample size: {value}") from e
    if n < 0:
        raise ValueError(f"no sample size: {value}")
    return min(n, population)


def allocate(sizes: DataFrame, stratum: str, n: int) -> DataFrame:
    """Adds ``take`` to (stratum, size): n rows shared out by size.

    With n at least the number of strata each gets one, and the rest goes by size less one;
    remainders go to the largest fractions, then sizes, then least names.
    """
    got = sizes.agg(F.count("*"), F.sum("size")).first()  # two numbers
    k, total = got[0], got[1] or 0
    n = min(n, total)
    one = 1 if n >= k else 0
    rest, weight = n - one * k, total - one * k
    # whole numbers throughout: floor and remainder of rest * weight of the stratum / all weights
    share = (F.col("size") - one).cast("decimal(38,0)") * rest
    whole = F.floor(share / weight).cast("long") if weight > 0 else F.lit(0).cast("long")
    d = sizes.select(stratum, "size", whole.alias("__q"))
    d = d.withColumn("__r", (share - F.col("__q").cast("decimal(38,0)") * weight).cast("decimal(38,0)") if weight > 0 else F.lit(0).cast("decimal(38,0)"))
    d = d.withColumn("__q", F.when(F.col("__r") < 0, F.col("__q") - 1).otherwise(F.col("__q"))).withColumn("__r", F.when(F.col("__r") < 0, F.col("__r") + weight).otherwise(F.col("__r")))
    left = rest - (d.agg(F.sum("__q")).first()[0] or 0)  # at most n
    extra = d.orderBy(F.desc("__r"), F.desc("size"), F.asc(stratum)).limit(max(0, int(left))).select(F.col(stratum).alias("__s"), F.lit(1).alias("__x"))
    out = d.join(extra, F.col(stratum).eqNullSafe(F.col("__s")), "left")
    return out.select(stratum, "size", (F.col("__q") + one + F.coalesce("__x", F.lit(0))).cast("long").alias("take"))


def stratified(df: DataFrame, stratum: str, order: list[Column], n: int) -> DataFrame:
    """n rows of all strata, evenly spaced in each; the midpoints of equal parts are taken."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    plan = allocate(sizes, stratum, n).where("take > 0")
    picks = plan.select(stratum, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("take") - 1), lambda i: F.expr("0").cast("long") + F.floor((i * 2 + 1) * F.col("size") / (F.col("take") * 2)).cast("long"))).alias("__i"))
    placed = row_numbers(df, [stratum], order, "__i").withColumn("__i", F.col("__i") - 1)
    return placed.join(picks, [stratum, "__i"], "left_semi").drop("__i")


def midpoints(size: int, take: int) -> list[int]:
    """The same places for one stratum, for the driver."""
    return [math.floor((i * 2 + 1) * size / (take * 2)) for i in range(take)]
