"""Items of providers: their merge with resources and payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identity import resolve

KEY = ["provider", "account", "native_id"]


def upsert_items(state: DataFrame, batch: DataFrame, known: DataFrame) -> DataFrame:
    """Items after a batch, with ``action`` and ``restored``.

    ``state`` holds KEY, resource_id, metadata_hash, payload_hash and removed_at; ``batch`` KEY, url,
    metadata_hash and payload_hash, one row an item; ``known`` resource_id and canonical_url.  An item
    changes if its metadata or its payload do; a batch without a payload keeps the old one's hash.
    An item that comes again is no longer removed, and belongs to the resource of its URL.
    Items that the batch lacks stay.
    """
    placed = resolve(batch.withColumn("__k", F.concat_ws("\0", *KEY)), known, "__k", "url")
    new = placed.select(*KEY, F.struct("resource_id", "metadata_hash", "payload_hash").alias("n"))
    old = state.select(*KEY, F.struct("resource_id", "metadata_hash", "payload_hash", "removed_at").alias("o"))
    both = old.join(new, KEY, "full")
    payload = F.coalesce("n.payload_hash", "o.payload_hash")
    same = F.col("n.metadata_hash").eqNullSafe(F.col("o.metadata_hash")) & payload.eqNullSafe(F.col("o.payload_hash"))
    action = F.when(F.col("n").isNull(), "keep").when(F.col("o").isNull(), "insert").when(same, "unchanged").otherwise("update")
    return both.select(
        *KEY, F.coalesce("n.resource_id", "o.resource_id").alias("resource_id"), F.coalesce("n.metadata_hash", "o.metadata_hash").alias("metadata_hash"), payload.alias("payload_hash"),
        F.when(F.col("n").isNull(), F.col("o.removed_at")).alias("removed_at"), action.alias("action"), (F.col("n").isNotNull() & F.col("o.removed_at").isNotNull()).alias("restored"),
    )


def feed_metadata(items: DataFrame) -> DataFrame:
    """The provider metadata of the newest item of each feed (provider_metadata with ``feed_url``, updated_at, source_id)."""
    url = F.try_element_at("provider_metadata", F.lit("feed_url"))
    rows = items.select(url.alias("feed_url"), "provider_metadata", F.struct("updated_at", "source_id").alias("o")).where("feed_url <> ''")
    return rows.groupBy("feed_url").agg(F.max_by("provider_metadata", "o").alias("provider_metadata"))
