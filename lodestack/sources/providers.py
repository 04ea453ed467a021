"""Several sources as one, and the records that all of them give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.times import iso_text
from ..functions.urls import url_host
from ..operators.latest import latest_by_key

FIELDS = ("source", "source_id", "url", "title", "excerpt", "comment", "tags", "created_at", "updated_at", "private", "item_type")


def as_item(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of any source as items; fields that it lacks are empty text, no tags, or null."""
    empty = {"tags": F.array().cast("array<string>"), "private": F.lit(None).cast("boolean"), "item_type": F.lit("link")}
    return df.select(*[F.coalesce(columns[f], empty.get(f, F.lit(""))).alias(f) if f in columns and f != "private" else columns.get(f, empty.get(f, F.lit(""))).alias(f) for f in FIELDS])


def union_sources(sources: list[DataFrame], first_wins: bool = True) -> DataFrame:
    """Items of all sources; of one source_id the first (or last) source's row stays."""
    out = None
    for i, s in enumerate(sources):
        one = s.withColumn("__s", F.lit(-i if first_wins else i))
        out = one if out is None else out.unionByName(one)
    return latest_by_key(out.withColumn("__h", F.xxhash64(*[F.col(c) for c in FIELDS])), ["source_id"], [F.col("__s"), F.col("__h")]).drop("__s", "__h")


def metadata(items: DataFrame) -> DataFrame:
    """source_id and the item's fields as one map, with its domain."""
    pairs = [F.lit("domain"), F.coalesce(url_host("url"), F.lit(""))]
    for c in ("source", "url", "title", "excerpt", "comment", "created_at", "updated_at", "item_type"):
        pairs += [F.lit(c), F.coalesce(c, F.lit(""))]
    return items.select("source_id", F.create_map(*pairs).alias("metadata"))


def from_metadata(df: DataFrame, default_source: str) -> DataFrame:
    """Items from such maps; an empty source is the default one."""
    m = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    source = F.when(strip(m("source")) == "", default_source).otherwise(m("source"))
    return df.select("source_id", source.alias("source"), *[m(c).alias(c) for c in ("url", "title", "excerpt", "comment", "created_at", "updated_at")])


def discussion(responses: DataFrame) -> DataFrame:
    """Comments of public discussions (resource_id, body JSON) that say something."""
    kind = "count int, entry_url string, eid string, bookmarks array<struct<user: string, tags: array<string>, timestamp: string, comment: string>>"
    r = responses.select("resource_id", F.from_json("body", kind).alias("r"))
    rows = r.select("resource_id", F.col("r.eid").alias("entry_id"), F.posexplode("r.bookmarks").alias("pos", "b"))
    return rows.where(F.coalesce("b.comment", F.lit("")) != "").select("resource_id", "entry_id", "pos", "b.user", "b.tags", "b.timestamp", "b.comment")


def epoch_text(seconds: Column) -> Column:
    return iso_text(F.timestamp_seconds(seconds))
