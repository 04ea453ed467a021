"""Resources behind items: all spellings of a URL are one resource."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url


def resolve(items: DataFrame, known: DataFrame, key: str, url: str) -> DataFrame:
    """Items with the resource they belong to: a known one with the same canonical URL, else a new one.

    ``known`` holds resource_id and canonical_url.  New ids come from the URL, so that a second
    run finds the same.  Items without a URL belong to a resource of their own.
    """
    canon = items.withColumn("canonical_url", canonical_url(F.col(url)))
    canon = canon.withColumn("canonical_url", F.when(F.coalesce("canonical_url", F.lit("")) == "", F.concat(F.lit("item:"), F.col(key))).otherwise(F.col("canonical_url")))
    new_id = F.concat(F.lit("res-"), F.substring(F.sha2("canonical_url", 256), 1, 24))
    return canon.join(known.select("resource_id", "canonical_url"), "canonical_url", "left").withColumn("is_new", F.col("resource_id").isNull()).withColumn("resource_id", F.coalesce("resource_id", new_id))


def shared_resources(items: DataFrame, key: str, url: str) -> DataFrame:
    """One row a canonical URL: how many items and spellings it has, and its first item."""
    c = items.select(F.col(key), F.col(url), canonical_url(F.col(url)).alias("canonical_url")).where(F.col("canonical_url").isNotNull())
    return c.groupBy("canonical_url").agg(F.count_distinct(key).alias("items"), F.count_distinct(url).alias("spellings"), F.min(key).alias("first_item"))
