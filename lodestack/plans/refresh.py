"""What a run has to do: which resources are due, which are still without a body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.times import backoff_minutes


def failing(capture: DataFrame) -> Column:
    """Whether the last capture of a resource (warning, has_payload, body) left nothing to show."""
    return (F.coalesce("warning", F.lit("")) != "") & ~F.col("has_payload") & is_blank("body")


def due(captures: DataFrame, now: Column, refresh_days: int, terminal_statuses: tuple[int, ...], terminal_kinds: tuple[str, ...], kind_failures: int, base_minutes: float, most_days: float) -> DataFrame:
    """Adds ``due`` to the last captures of resources.

    Columns: fetched_at (null if never fetched), warning, has_payload, body, http_status,
    failure_kind, failures.  The rules are a table of conditions in one expression, so that
    the scan stays the only pass.
    """
    age = (F.unix_micros(now) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / F.lit(60_000_000.0)
    rule = (
        F.when(F.col("fetched_at").isNull(), True)
        .when(~failing(captures), age >= max(1, refresh_days) * 1440)
        .when(F.col("http_status").isin(*terminal_statuses) if terminal_statuses else F.lit(False), False)
        .when((F.col("failure_kind").isin(*terminal_kinds) if terminal_kinds else F.lit(False)) & (F.col("failures") >= kind_failures), False)
        .when(F.col("failures") == 0, True)
        .otherwise(age >= backoff_minutes("failures", base_minutes, most_days))
    )
    return captures.withColumn("due", F.coalesce(rule, F.lit(False)))
