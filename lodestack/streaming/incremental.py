"""Incremental runs: merges of batches into a table, and failure streaks as keyed state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import merge, tables


def merge_stream(stream: DataFrame, path: str, keys: list[str], seq: str, compare: list[str], checkpoint: str, done: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Keeps the table at ``path`` up to date with a stream of deliveries.

    A micro-batch is reduced to the last delivery of each key and merged into the buckets that
    it touches.  The number of the batch is part of the version that it makes, so a batch that comes
    again after a failure is passed over: every delivery counts exactly once.  See
    :mod:`lodestack.operators.tables`, which also reads the table.
    """

    def step(batch: DataFrame, number: int) -> None:
        counts = tables.merge_batch(merge.one_per_key(batch, keys, F.col(seq)), path, keys, compare, checkpoint, number)
        if done and counts is not None:
            done(number, counts)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def known_skip(deliveries: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Deliveries whose key the table does not hold yet."""
    return deliveries.join(table.select(key), key, "left_anti")


def streak_stream(attempts: DataFrame, key: str) -> DataFrame:
    """Latest streak of each key from a stream of (key, seq, failed, reset).

    Rows of a micro-batch are taken in the order of ``seq``; the state is a number a key.
    """

    def step(k: tuple, frames, state: GroupState):
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        failed, reset = rows["failed"].to_numpy(bool), rows["reset"].to_numpy(bool)
        cleared = (reset & ~failed).nonzero()[0]
        n = int(failed[cleared[-1] + 1 :].sum()) if len(cleared) else n + int(failed.sum())
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "streak": [n]})

    kind = dict(attempts.dtypes)[key]
    return attempts.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, streak int", "n int", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, late: str = "1 day") -> DataFrame:
    """Events of each kind in tumbling windows, an addition to the archive's own operators."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), kind, "events")


def session(spark: SparkSession) -> SparkSession:
    """Settings of keyed state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark
