"""Forward-only migrations of the archive's tables, each a function of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .latest import latest_by_key, top_n

Tables = dict[str, DataFrame]
STEPS: dict[int, Callable[[Tables], Tables]] = {}


def step(version: int):
    """Registers the step from a version to the next."""

    def add(f: Callable[[Tables], Tables]):
        STEPS[version] = f
        return f

    return add


def migrate(tables: Tables, version: int, target: int) -> Tables:
    """Tables brought from one version to another; going back, or over a gap, fails."""
    if version > target:
        raise ValueError(f"version {version} is newer than {target}")
    missing = [v for v in range(version, target) if v not in STEPS]
    if missing:
        raise ValueError(f"no step from version {missing[0]}")
    for v in range(version, target):
        tables = STEPS[v](dict(tables))
    return tables


@step(1)
def one_capture_a_resource(t: Tables) -> Tables:
    """Of several captures the best stays: with a payload, then the newest."""
    c = t["fetch_capture"].withColumn("__p", F.col("http_payload_id").isNotNull())
    t["fetch_capture"] = latest_by_key(c, ["resource_id"], [F.col("__p"), F.col("fetched_at"), F.col("fetch_capture_id")]).drop("__p")
    return t


@step(2)
def top_comments(t: Tables) -> Tables:
    """Twenty comments a resource stay, by stars, then age."""
    order = [F.coalesce("star_count", F.lit(0)).desc(), F.col("posted_at").asc_nulls_last(), F.col("comment_revision_id")]
    t["comment_revision"] = top_n(t["comment_revision"], ["resource_id"], order, 20).drop("rank")
    return t


@step(3)
def failure_counts(t: Tables) -> Tables:
    """Captures get a count of failures; what failed before counts as none yet."""
    c = t["fetch_capture"]
    if "consecutive_failures" not in c.columns:
        c = c.withColumn("consecutive_failures", F.lit(0))
    t["fetch_capture"] = c.withColumn("consecutive_failures", F.greatest(F.coalesce("consecutive_failures", F.lit(0)), F.lit(0)))
    return t
