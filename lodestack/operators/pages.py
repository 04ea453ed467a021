"""What fetches leave: revisions and captures of resources, and what follows from them.

State is one capture and at most one current revision a resource.  Each function takes a batch
with one outcome a resource; a run with several is merged wave by wave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import json
from ..functions.text import is_blank
from .latest import latest_by_key

CAPTURE = (
    "resource_id string, fetch_capture_id string, resource_revision_id string, http_payload_id string, rendered_payload_id string, final_url string, extracted_by string, content_truncated boolean, "
    "warning string, response_etag string, response_last_modified string, consecutive_failures int, http_status int, failure_kind string, fetched_at timestamp"
)
_KEPT = [c.split()[0] for c in CAPTURE.split(", ")][2:]
REVISION = ("title", "content_markdown", "discussion_text")


def content_hash(title: Column, content: Column, discussion: Column) -> Column:
    """Hash of a revision: of its texts as JSON with sorted keys."""
    return json.content_hash(content_markdown=content, discussion_text=discussion, title=title)


def latest_captures(captures: DataFrame) -> DataFrame:
    """The newest capture of each resource; of several at one time that with the greatest id."""
    return latest_by_key(captures, ["resource_id"], [F.col("fetched_at"), F.col("fetch_capture_id")])


def _new_id(kind: str) -> Column:
    """An id that a second run finds again."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("\0", "resource_id", F.col("at").cast("string")), 256), 1, 24))


def record_fetches(captures: DataFrame, revisions: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and current revisions after a batch of fetches, the revisions with ``action``.

    ``outcomes`` holds resource_id, outcome, at, and what a fetch found (any of the columns of
    captures and revisions; those missing are null).  Outcome ``page`` brings a revision (a blank one as
    well) and replaces the capture; failures go back to 0 and their kind to null only with a body.
    ``failed`` adds a failure, overwrites status and kind, keeps payloads and address unless there are
    new ones, and detaches a blank revision.  ``same`` (not modified) only refreshes a capture that is
    there: no failures, no warning, status 304, validators kept unless there are new ones.
    Resources without an outcome stay as they are (``keep``).
    """
    given = {c for c in outcomes.columns}
    text = lambda c: F.col(c) if c in given else F.lit(None).cast("string")
    new = outcomes.select(
        "resource_id", "outcome", "at", *[text(c).alias(f"n_{c}") for c in (*REVISION, "http_payload_id", "rendered_payload_id", "final_url", "extracted_by", "warning", "response_etag", "response_last_modified", "failure_kind")],
        (F.col("content_truncated") if "content_truncated" in given else F.lit(False)).alias("n_content_truncated"), (F.col("http_status") if "http_status" in given else F.lit(None)).cast("int").alias("n_http_status"),
    )
    old = captures.select("resource_id", F.lit(True).alias("captured"), "fetch_capture_id", *_KEPT)
    held = revisions.select("resource_id", F.col("resource_revision_id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in REVISION], F.col("created_at").alias("r_created_at"))
    all_ = old.join(held, "resource_id", "full").join(new, "resource_id", "full")
    page, failed, same = (F.coalesce(F.col("outcome") == o, F.lit(False)) for o in ("page", "failed", "same"))
    body = page & ~is_blank("n_content_markdown")
    changed = F.lit(False)
    for c in REVISION:
        changed = changed | ~F.coalesce(f"n_{c}", F.lit("")).eqNullSafe(F.coalesce(f"r_{c}", F.lit("")))
    detached = failed & F.col("r_id").isNotNull() & is_blank("r_content_markdown")
    action = F.when(page & F.col("r_id").isNull(), "insert").when(page & changed, "update").when(page, "unchanged").when(detached, "detach").otherwise("keep")
    all_ = all_.withColumn("action", action).withColumn("rid", F.when(page, F.coalesce("r_id", _new_id("rev"))).otherwise(F.col("r_id")))
    take = F.col("action").isin("insert", "update")
    revised = all_.where(F.col("rid").isNotNull()).select(
        "resource_id", F.col("rid").alias("resource_revision_id"), *[F.when(take, F.coalesce(f"n_{c}", F.lit(""))).otherwise(F.col(f"r_{c}")).alias(c) for c in REVISION],
        F.when(take, F.col("at")).otherwise(F.col("r_created_at")).alias("created_at"), "action",
    )
    known = F.coalesce("captured", F.lit(False))
    fails = F.coalesce("consecutive_failures", F.lit(0))

    def pick(name: str, on_page: Column, on_failed: Column, on_same: Column) -> Column:
        return F.when(page, on_page).when(failed, on_failed).when(same, on_same).otherwise(F.col(name)).alias(name)

    fresh = lambda c: F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), F.col(c))
    n = lambda c: F.col(f"n_{c}")
    none = F.lit(None)
    after = all_.where(known | page | failed).select(
        "resource_id", F.coalesce("fetch_capture_id", _new_id("cap")).alias("fetch_capture_id"), F.when(page | failed, F.col("rid")).otherwise(F.col("resource_revision_id")).alias("resource_revision_id"),
        pick("http_payload_id", n("http_payload_id"), F.coalesce("n_http_payload_id", "http_payload_id"), F.col("http_payload_id")),
        pick("rendered_payload_id", n("rendered_payload_id"), F.coalesce("n_rendered_payload_id", "rendered_payload_id"), F.col("rendered_payload_id")),
        pick("final_url", n("final_url"), fresh("final_url"), n("final_url")), pick("extracted_by", n("extracted_by"), F.col("extracted_by"), F.col("extracted_by")),
        pick("content_truncated", n("content_truncated"), F.col("content_truncated"), F.col("content_truncated")), pick("warning", n("warning"), n("warning"), none),
        pick("response_etag", n("response_etag"), n("response_etag"), fresh("response_etag")), pick("response_last_modified", n("response_last_modified"), n("response_last_modified"), fresh("response_last_modified")),
        pick("consecutive_failures", F.when(body, 0).otherwise(fails), fails + 1, F.lit(0)), pick("http_status", n("http_status"), n("http_status"), F.lit(304)),
        pick("failure_kind", F.when(body, none).otherwise(F.col("failure_kind")), n("failure_kind"), none), F.when(page | failed | same, F.col("at")).otherwise(F.col("fetched_at")).alias("fetched_at"),
    )
    return after, revised


def _with_body(captures: DataFrame, revisions: DataFrame) -> DataFrame:
    return captures.join(revisions.select("resource_id", F.col("content_markdown").alias("body")), "resource_id", "left")


def terminal(captures: DataFrame, revisions: DataFrame, statuses: tuple[int, ...], kinds: tuple[str, ...], kind_failures: int = 3) -> DataFrame:
    """Captures of resources that are no longer tried: a final status, or a final kind of failure often enough, with a warning, without payload and body.

    An empty list leaves out its half; both empty give none.
    """
    final = F.lit(False)
    if statuses:
        final = final | F.col("http_status").isin(*statuses)
    if kinds:
        final = final | (F.col("failure_kind").isin(*kinds) & (F.col("consecutive_failures") >= kind_failures))
    rows = _with_body(captures, revisions).where(F.coalesce(final, F.lit(False)) & (F.coalesce("warning", F.lit("")) != ""))
    return rows.where(F.col("http_payload_id").isNull() & F.col("rendered_payload_id").isNull() & is_blank("body")).select(*captures.columns)


def validators(captures: DataFrame, revisions: DataFrame) -> DataFrame:
    """resource_id, etag and last_modified to send along; empty while no body is held, so that a page is not answered by "not modified"."""
    held = ~is_blank("body")
    send = lambda c: F.when(held, F.coalesce(c, F.lit(""))).otherwise("")
    return _with_body(captures, revisions).select("resource_id", send("response_etag").alias("etag"), send("response_last_modified").alias("last_modified"))


def backlog(items: DataFrame, captures: DataFrame, revisions: DataFrame, providers: list[str], account: str = "default") -> DataFrame:
    """resource_id, url and fetched_at of resources whose body was never had, of items (resource_id, url, provider, account, removed_at) of some providers.

    These have no revision, or a blank one with a warning.  To be taken in the order of
    fetched_at, nulls first.  Removed items don't count.
    """
    own = items.where(F.col("provider").isin(*providers) & (F.col("account") == account) & F.col("removed_at").isNull()).groupBy("resource_id").agg(F.min("url").alias("url"))
    state = captures.select("resource_id", "warning", "fetched_at")
    bodies = revisions.select("resource_id", F.lit(True).alias("revised"), F.col("content_markdown").alias("body"))
    rows = own.join(state, "resource_id", "left").join(bodies, "resource_id", "left")
    return rows.where(F.col("revised").isNull() | (is_blank("body") & (F.coalesce("warning", F.lit("")) != ""))).select("resource_id", "url", "fetched_at")


def conditional_state(state: DataFrame, answers: DataFrame) -> DataFrame:
    """Validators of feeds (feed_url, etag, last_modified) after answers (feed_url, http_status, etag, last_modified): those of sound answers, old ones where an answer brings none."""
    good = answers.where("http_status in (200, 304)").groupBy("feed_url").agg(F.max("etag").alias("n_etag"), F.max("last_modified").alias("n_last"))
    keep = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old))
    return state.join(good, "feed_url", "full").select("feed_url", keep("n_etag", "etag").alias("etag"), keep("n_last", "last_modified").alias("last_modified"))


def merged_warning(*warnings: Column) -> Column:
    """Warnings of the steps of a fetch as one; null without any."""
    return F.nullif(F.concat_ws("; ", *[F.nullif(w, F.lit("")) for w in warnings]), F.lit(""))
