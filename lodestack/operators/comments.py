"""Comments of resources: which are due, their merge, their state, their stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import star_url
from .latest import top_n
from .merge import carry_over, upsert

KEY = ["provider", "resource_id", "author"]
FIELDS = ["body", "tags_json", "star_count", "posted_at", "metadata_json"]


def due(targets: DataFrame, counts: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Targets (resource_id, url) whose comments are worth a look: the count of their URL has changed, or one of both counts is not known."""
    now = counts.groupBy("url").agg(F.max("count").alias("__now"))
    before = state.select("resource_id", F.col("bookmark_count").alias("__before"))
    rows = targets.join(now, "url", "left").join(before, "resource_id", "left")
    return rows.where(F.lit(force) | F.col("__now").isNull() | ~F.col("__now").eqNullSafe(F.col("__before"))).select(*targets.columns)


def select_top(comments: DataFrame, stars: DataFrame, n: int = 20) -> DataFrame:
    """The first n comments (resource_id, author, posted_at, entry_id, ...) of each resource by stars, then time, undated last, then author.

    Stars are looked up by address; a comment without address or count has none.
    """
    rows = comments.where(F.coalesce("author", F.lit("")) != "").withColumn("__url", star_url("author", "posted_at", "entry_id"))
    found = stars.groupBy(F.col("url").alias("__url")).agg(F.max("count").alias("__n"))
    rows = rows.join(found, "__url", "left").withColumn("star_count", F.coalesce(F.when(F.col("__url") != "", F.col("__n")), F.lit(0)).cast("int")).drop("__url", "__n")
    undated = F.coalesce("posted_at", F.lit("")) == ""
    return top_n(rows, ["resource_id"], [F.desc("star_count"), undated.asc(), F.col("posted_at"), F.col("author")], n).drop("rank")


def merge_comments(existing: DataFrame, batch: DataFrame, replace: bool = False) -> DataFrame:
    """Comments after a batch, with ``action``; both hold KEY, FIELDS and, the first, removed_at.

    Stars that the batch does not know stay.  A removed comment that comes again is back, as an
    update.  ``replace`` deletes the comments of the batch's resources whose author it lacks.  A comment
    without author fails the job.
    """
    checked = batch.withColumn("author", F.when(F.coalesce("author", F.lit("")) == "", F.raise_error(F.lit("a comment has no author")).cast("string")).otherwise(F.col("author")))
    filled = carry_over(existing, checked.select(*KEY, *FIELDS), KEY, ["star_count"]).withColumn("removed_at", F.lit(None).cast("timestamp"))
    merged = upsert(existing.select(*KEY, *FIELDS, F.col("removed_at").cast("timestamp").alias("removed_at")), filled, KEY, [*FIELDS, "removed_at"])
    if not replace:
        return merged
    whole = batch.select("provider", "resource_id").distinct().withColumn("__whole", F.lit(True))
    gone = (F.col("action") == "keep") & F.coalesce("__whole", F.lit(False))
    return merged.join(whole, ["provider", "resource_id"], "left").withColumn("action", F.when(gone, "delete").otherwise(F.col("action"))).drop("__whole")


def put_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """States (provider, resource_id, bookmark_count, entry_url, entry_id, checked_at) after a batch; counts are at least 0."""
    one = batch.withColumn("bookmark_count", F.greatest(F.coalesce(F.col("bookmark_count").cast("int"), F.lit(0)), F.lit(0)))
    return state.join(one.select("provider", "resource_id"), ["provider", "resource_id"], "left_anti").unionByName(one.select(*state.columns))


def stars_due(comments: DataFrame, state: DataFrame, cutoff: Column, force: bool = False) -> DataFrame:
    """Comments (provider, resource_id, removed_at, star_checked_at, ...) with the entry_id of their resource whose stars are due: never looked at, or not since the cutoff."""
    rows = comments.where(F.col("removed_at").isNull() & (F.lit(force) | F.col("star_checked_at").isNull() | (F.col("star_checked_at") < cutoff)))
    return rows.join(state.select("provider", "resource_id", "entry_id"), ["provider", "resource_id"])


def update_stars(comments: DataFrame, updates: DataFrame, key: str, checked_at: Column) -> DataFrame:
    """Comments after counts (key, star_count) came in, with ``changed``.

    A null count only says that the comment was looked at; the time of a revision moves only
    with a changed count.
    """
    new = updates.groupBy(key).agg(F.max(F.when(F.col("star_count").isNotNull(), F.greatest(F.col("star_count").cast("int"), F.lit(0)))).alias("__n")).withColumn("__asked", F.lit(True))
    asked, known = F.coalesce("__asked", F.lit(False)), F.col("__n").isNotNull()
    changed = F.coalesce(known & ~F.col("__n").eqNullSafe(F.col("star_count")), F.lit(False))
    rows = comments.join(new, key, "left").withColumn("changed", changed)
    out = {"star_count": F.coalesce("__n", "star_count"), "star_checked_at": F.when(asked, checked_at).otherwise(F.col("star_checked_at"))}
    if "created_at" in comments.columns:
        out["created_at"] = F.when(F.col("changed"), checked_at).otherwise(F.col("created_at"))
    return rows.select(*[out[c].alias(c) if c in out else F.col(c) for c in comments.columns], "changed")


def refresh(targets: DataFrame, counts: DataFrame, state: DataFrame, discussions: DataFrame, stars: DataFrame, existing: DataFrame, provider: str, force: bool = False) -> DataFrame:
    """The whole of a refresh: targets that are due, the top comments of their discussions, and their merge in place of the old ones."""
    own = discussions.join(due(targets, counts, state, force).select("resource_id"), "resource_id", "left_semi")
    top = select_top(own, stars).withColumn("provider", F.lit(provider))
    return merge_comments(existing, top.select(*KEY, *FIELDS), replace=True)
