"""Queries of merges, fetches, comments and runs, each with the SQL that says the same; see :mod:`.catalogue`."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import NOW, _canonical_sql, _items, _strip_sql, query
from .functions import text, urls
from .operators import comments, items, pages, source_notes
from .plans import refresh, runs
from .runtime import table

# --- fetches --------------------------------------------------------------------------------

_CAPTURES = """cap AS (SELECT * FROM (SELECT DISTINCT resource_id, fetch_capture_id, resource_revision_id, http_payload_id, rendered_payload_id, final_url, extracted_by, content_truncated, warning, response_etag, response_last_modified, consecutive_failures, http_status, failure_kind, fetched_at FROM fetch_capture)
QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC NULLS LAST, fetch_capture_id DESC NULLS LAST) = 1)"""
_REVISIONS = "rev AS (SELECT c.resource_id, r.* EXCLUDE (resource_id) FROM cap c JOIN (SELECT DISTINCT resource_id, resource_revision_id, title, content_markdown, discussion_text, created_at FROM resource_revision) r ON c.resource_revision_id = r.resource_revision_id)"


def _blank_sql(x: str) -> str:
    return f"coalesce({_strip_sql(x)}, '') = ''"


def _captures(spark, d):
    names = [c.split()[0] for c in pages.CAPTURE.split(", ")]
    return pages.latest_captures(table(spark, d, "fetch_capture").select(*names).distinct())


def _revisions(spark, d, captures):
    """Current revisions: those that the captures name.  Copies of a revision are one, without a comparison of their texts."""
    r = table(spark, d, "resource_revision").select("resource_revision_id", "title", "content_markdown", "discussion_text", "created_at").dropDuplicates(["resource_revision_id"])
    return captures.select("resource_id", "resource_revision_id").join(r, "resource_revision_id")


@query(f"""WITH {_CAPTURES}, {_REVISIONS},
new AS (SELECT resource_id, fetched_at, text, title, error, final_url, http_status, failure_kind, extraction_method, content_truncated,
CASE WHEN http_status = 304 THEN 'same' WHEN coalesce(error, '') <> '' AND {_blank_sql('text')} THEN 'failed' ELSE 'page' END AS outcome FROM (SELECT DISTINCT * FROM page_fetch) QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC NULLS LAST, page_fetch_id DESC) = 1),
j AS (SELECT coalesce(c.resource_id, n.resource_id) AS resource_id, c.resource_id IS NOT NULL AS known, n.outcome, n.*EXCLUDE (resource_id, outcome), c.consecutive_failures AS old_failures, c.http_status AS old_status, c.failure_kind AS old_kind, c.warning AS old_warning, c.final_url AS old_url, c.http_payload_id AS old_payload,
r.resource_revision_id AS rid, r.title AS r_title, r.content_markdown AS r_body, r.discussion_text AS r_talk FROM cap c FULL JOIN new n ON c.resource_id = n.resource_id LEFT JOIN rev r ON r.resource_id = c.resource_id)
SELECT resource_id, CASE WHEN outcome = 'page' AND rid IS NULL THEN 'insert' WHEN outcome = 'page' AND (coalesce(title, '') <> coalesce(r_title, '') OR coalesce(text, '') <> coalesce(r_body, '') OR coalesce(r_talk, '') <> '') THEN 'update' WHEN outcome = 'page' THEN 'unchanged'
WHEN outcome = 'failed' AND rid IS NOT NULL AND {_blank_sql('r_body')} THEN 'detach' WHEN rid IS NOT NULL THEN 'keep' END AS action,
CASE outcome WHEN 'page' THEN CASE WHEN {_blank_sql('text')} THEN coalesce(old_failures, 0) ELSE 0 END WHEN 'failed' THEN coalesce(old_failures, 0) + 1 WHEN 'same' THEN 0 ELSE old_failures END::INT AS consecutive_failures,
CASE outcome WHEN 'page' THEN http_status WHEN 'failed' THEN http_status WHEN 'same' THEN 304 ELSE old_status END AS http_status,
CASE outcome WHEN 'page' THEN CASE WHEN {_blank_sql('text')} THEN old_kind END WHEN 'failed' THEN failure_kind WHEN 'same' THEN NULL ELSE old_kind END AS failure_kind,
CASE WHEN outcome IN ('page', 'failed') THEN error WHEN outcome = 'same' THEN NULL ELSE old_warning END AS warning,
CASE outcome WHEN 'page' THEN final_url WHEN 'failed' THEN coalesce(nullif(final_url, ''), old_url) WHEN 'same' THEN final_url ELSE old_url END AS final_url,
CASE WHEN outcome = 'page' THEN NULL ELSE old_payload END AS http_payload_id FROM j WHERE known OR outcome <> 'same'""")
def recorded_fetches(spark, d):
    """Captures and revisions after the last fetch of each resource came in."""
    captures = _captures(spark, d)
    p = table(spark, d, "page_fetch")
    kind = F.when(F.col("http_status") == 304, "same").when((F.coalesce("error", F.lit("")) != "") & text.is_blank("text"), "failed").otherwise("page")
    last = pages.latest_by_key(p.select("resource_id", "page_fetch_id", "fetched_at").distinct(), ["resource_id"], [F.col("fetched_at"), F.col("page_fetch_id")]).select("page_fetch_id")
    new = p.join(last, "page_fetch_id", "left_semi").dropDuplicates(["page_fetch_id"]).select(
        "resource_id", kind.alias("outcome"), F.col("fetched_at").cast("timestamp").alias("at"), F.col("text").alias("content_markdown"), "title", F.col("error").alias("warning"), "final_url",
        F.col("extraction_method").alias("extracted_by"), "content_truncated", "http_status", "failure_kind",
    )
    after, revised = pages.record_fetches(captures, _revisions(spark, d, captures), new)
    return after.join(revised.select("resource_id", "action"), "resource_id", "left").select("resource_id", "action", "consecutive_failures", "http_status", "failure_kind", "warning", "final_url", "http_payload_id")


@query(f"""WITH {_CAPTURES}, {_REVISIONS} SELECT http_status, failure_kind, count(*) AS resources FROM cap LEFT JOIN rev ON cap.resource_id = rev.resource_id
WHERE (http_status IN (404, 410) OR failure_kind IN ('dns', 'timeout') AND consecutive_failures >= 3) AND coalesce(warning, '') <> '' AND http_payload_id IS NULL AND rendered_payload_id IS NULL AND {_blank_sql('content_markdown')} GROUP BY ALL""")
def terminal_resources(spark, d):
    captures = _captures(spark, d)
    got = pages.terminal(captures, _revisions(spark, d, captures), (404, 410), ("dns", "timeout"), 3)
    return got.groupBy("http_status", "failure_kind").agg(F.count("*").alias("resources"))


@query(f"""WITH {_CAPTURES}, {_REVISIONS} SELECT cap.resource_id, CASE WHEN {_blank_sql('content_markdown')} THEN '' ELSE coalesce(response_etag, '') END AS etag, CASE WHEN {_blank_sql('content_markdown')} THEN '' ELSE coalesce(response_last_modified, '') END AS last_modified
FROM cap LEFT JOIN rev ON cap.resource_id = rev.resource_id""")
def fetch_validators(spark, d):
    captures = _captures(spark, d)
    return pages.validators(captures, _revisions(spark, d, captures))


@query(f"""WITH {_CAPTURES}, {_REVISIONS}, keyed AS (SELECT cap.*, content_markdown AS body, rev.resource_revision_id AS rid, 'url:' || sha256({_canonical_sql('final_url')}) AS k FROM cap LEFT JOIN rev ON cap.resource_id = rev.resource_id WHERE final_url IS NOT NULL),
state AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY fetched_at DESC NULLS LAST, fetch_capture_id DESC) = 1),
own AS (SELECT content_key, min({_canonical_sql('url')}) AS url FROM canonical_item WHERE source IN ('hatena', 'rss') AND NOT coalesce(private, false) GROUP BY 1)
SELECT content_key AS resource_id, own.url, fetched_at FROM own LEFT JOIN state ON content_key = k WHERE rid IS NULL OR {_blank_sql('body')} AND coalesce(warning, '') <> ''""")
def provider_backlog(spark, d):
    """Resources of some providers whose body was never had; private items count as removed."""
    captures = _captures(spark, d)
    revisions = _revisions(spark, d, captures)
    keyed = captures.where(F.col("final_url").isNotNull()).withColumn("key", urls.content_key("final_url"))
    state = pages.latest_by_key(keyed, ["key"], [F.col("fetched_at"), F.col("fetch_capture_id")])
    bodies = state.select("key", "resource_id").join(revisions.select("resource_id", "content_markdown"), "resource_id").select(F.col("key").alias("resource_id"), "content_markdown")
    state = state.select(F.col("key").alias("resource_id"), "warning", "fetched_at")
    own = _items(spark, d).select(
        F.col("content_key").alias("resource_id"), urls.canonical_url("url").alias("url"), F.col("source").alias("provider"), F.lit("default").alias("account"), F.when(F.coalesce("private", F.lit(False)), F.lit("2026-01-01")).alias("removed_at"),
    )
    return pages.backlog(own, state, bodies, ["hatena", "rss"])


@query(f"""WITH {_CAPTURES}, {_REVISIONS}, st AS (SELECT cap.*, content_markdown AS body, rev.resource_revision_id AS rid, date_diff('microsecond', fetched_at, TIMESTAMP '{NOW}') / 60000000.0 AS age FROM cap LEFT JOIN rev ON cap.resource_id = rev.resource_id),
due AS (SELECT *, coalesce(CASE WHEN fetched_at IS NULL THEN true WHEN NOT (coalesce(warning, '') <> '' AND http_payload_id IS NULL AND rendered_payload_id IS NULL AND {_blank_sql('body')}) THEN age >= 30 * 1440 WHEN http_status IN (404, 410) THEN false
WHEN failure_kind IN ('dns', 'timeout') AND consecutive_failures >= 3 THEN false WHEN consecutive_failures = 0 THEN true ELSE age >= least(30.0 * pow(2.0, least(consecutive_failures - 1, 62)), 43200.0) END, false) AS due FROM st)
SELECT resource_id, row_number() OVER (ORDER BY fetched_at ASC NULLS FIRST, resource_id) AS place FROM due WHERE due AND (rid IS NULL OR {_blank_sql('body')} AND coalesce(warning, '') <> '') AND resource_id NOT IN (SELECT resource_id FROM page_fetch WHERE resource_id IS NOT NULL AND http_status = 200) QUALIFY place <= 200""")
def backlog_retries(spark, d):
    """The first 200 resources without a body that a run retries, those aside that it has fetched already."""
    captures = _captures(spark, d)
    bodies = _revisions(spark, d, captures).select("resource_id", F.lit(True).alias("revised"), F.col("content_markdown").alias("body"))
    state = captures.join(bodies, "resource_id", "left").withColumn("has_payload", F.col("http_payload_id").isNotNull() | F.col("rendered_payload_id").isNotNull()).withColumn("failures", F.col("consecutive_failures"))
    due = refresh.due(state, F.lit(NOW).cast("timestamp"), 30, (404, 410), ("dns", "timeout"), 3, 30, 30)
    waiting = due.where(F.col("revised").isNull() | (text.is_blank("body") & (F.coalesce("warning", F.lit("")) != ""))).select("resource_id", "fetched_at")
    handled = table(spark, d, "page_fetch").where("http_status = 200").select("resource_id").distinct()
    return source_notes.retries(waiting, due.select("resource_id", "due"), handled, 200).select("resource_id", F.col("seq").cast("long").alias("place"))


# --- items and comments ------------------------------------------------------------------------

_HASH = "sha256(coalesce(excerpt, '') || '|' || coalesce(comment, '') || '|' || coalesce(updated_at, ''))"


@query(f"""WITH s AS (SELECT source_id, source, min({_canonical_sql('url')}) AS url, min({_HASH}) AS low, max({_HASH}) AS high FROM canonical_item GROUP BY ALL), known AS (SELECT DISTINCT {_canonical_sql('url')} AS c FROM page_fetch),
o AS (SELECT source, source_id, low, source_id LIKE '%a' AS gone FROM s WHERE source <> 'rss'), n AS (SELECT s.*, known.c IS NOT NULL AS found FROM s LEFT JOIN known ON url = c WHERE source <> 'raindrop')
SELECT coalesce(o.source_id, n.source_id) AS native_id, CASE WHEN n.source_id IS NULL THEN 'keep' WHEN o.source_id IS NULL THEN 'insert' WHEN o.low = n.high THEN 'unchanged' ELSE 'update' END AS action,
n.source_id IS NOT NULL AND coalesce(o.gone, false) AS restored, n.source_id IS NULL AND o.gone AS removed, coalesce(n.found, false) AS known FROM o FULL JOIN n ON o.source_id = n.source_id AND o.source = n.source""")
def upsert_resources(spark, d):
    """Items merged with their resources; some of the old ones were removed, and come back if the batch has them."""
    h = F.sha2(F.concat(F.coalesce("excerpt", F.lit("")), F.lit("|"), F.coalesce("comment", F.lit("")), F.lit("|"), F.coalesce("updated_at", F.lit(""))), 256)
    s = _items(spark, d).select("source", "source_id", urls.canonical_url("url").alias("url"), h.alias("h")).groupBy("source", "source_id").agg(F.min("url").alias("url"), F.min("h").alias("low"), F.max("h").alias("high"))
    key = [F.col("source").alias("provider"), F.lit("default").alias("account"), F.col("source_id").alias("native_id")]
    none = F.lit(None).cast("string")
    state = s.where("source <> 'rss'").select(*key, F.lit("old").alias("resource_id"), F.col("low").alias("metadata_hash"), none.alias("payload_hash"), F.when(F.col("source_id").endswith("a"), F.lit("2026-01-01")).alias("removed_at"))
    batch = s.where("source <> 'raindrop'").select(*key, "url", F.col("high").alias("metadata_hash"), none.alias("payload_hash"))
    known = table(spark, d, "page_fetch").select(urls.canonical_url("url").alias("canonical_url")).distinct().select("canonical_url", F.concat(F.lit("known-"), F.sha2("canonical_url", 256)).alias("resource_id"))
    got = items.upsert_items(state, batch, known)
    return got.select("native_id", "action", "restored", F.col("removed_at").isNotNull().alias("removed"), F.col("resource_id").startswith("known-").alias("known"))


_SIDES = """c AS (SELECT DISTINCT right(comment_id, 2) AS resource_id, comment_id AS author, body, star_count, created_at FROM comment_revision),
t AS (SELECT *, author LIKE '%7' AS gone FROM c WHERE created_at < TIMESTAMP '2026-01-01'), b AS (SELECT resource_id, author, body, CASE WHEN created_at >= TIMESTAMP '2025-09-01' THEN star_count END AS star_count FROM c WHERE created_at >= TIMESTAMP '2025-07-01')"""


@query(f"""WITH {_SIDES} SELECT coalesce(t.author, b.author) AS author, coalesce(b.star_count, t.star_count) AS star_count,
CASE WHEN t.author IS NULL THEN 'insert' WHEN b.author IS NULL THEN CASE WHEN t.resource_id IN (SELECT resource_id FROM b) THEN 'delete' ELSE 'keep' END WHEN t.gone THEN 'update' ELSE 'unchanged' END AS action FROM t FULL JOIN b ON t.author = b.author AND t.resource_id = b.resource_id""")
def merged_comments(spark, d):
    """A refresh of the comments of some resources in place of the old ones; some of these were removed."""
    c = table(spark, d, "comment_revision").select(
        F.lit("hatena").alias("provider"), F.substring("comment_id", -2, 2).alias("resource_id"), F.col("comment_id").alias("author"), "body", F.lit("[]").alias("tags_json"), "star_count", F.lit("").alias("posted_at"), F.lit("{}").alias("metadata_json"), "created_at",
    ).distinct()
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    old = c.where(F.col("created_at") < at("2026-01-01")).withColumn("removed_at", F.when(F.col("author").endswith("7"), F.lit("2026-01-01").cast("timestamp")))
    new = c.where(F.col("created_at") >= at("2025-07-01")).withColumn("star_count", F.when(F.col("created_at") >= at("2025-09-01"), F.col("star_count")))
    return comments.merge_comments(old, new, replace=True).select("author", "star_count", "action")


@query("""WITH c AS (SELECT DISTINCT comment_revision_id, body, star_count, star_checked_at FROM comment_revision), u AS (SELECT comment_revision_id, CASE WHEN body LIKE '%e%' THEN length(body) % 5 END::INT AS n FROM c WHERE body LIKE '%a%')
SELECT c.comment_revision_id, coalesce(u.n, c.star_count) AS star_count, coalesce(u.n IS DISTINCT FROM c.star_count AND u.n IS NOT NULL, false) AS changed, CASE WHEN u.comment_revision_id IS NOT NULL THEN TIMESTAMP '2026-10-01 00:00:00' ELSE c.star_checked_at END AS star_checked_at FROM c LEFT JOIN u ON c.comment_revision_id = u.comment_revision_id""")
def star_updates(spark, d):
    """Comments after their stars were asked for; some answers are missing."""
    c = table(spark, d, "comment_revision").select("comment_revision_id", "body", "star_count", "star_checked_at").distinct()
    asked = c.where(F.col("body").contains("a")).select("comment_revision_id", F.when(F.col("body").contains("e"), F.length("body") % 5).alias("star_count"))
    return comments.update_stars(c, asked, "comment_revision_id", F.lit("2026-10-01 00:00:00").cast("timestamp_ntz")).select("comment_revision_id", "star_count", "changed", "star_checked_at")


@query("""WITH i AS (SELECT DISTINCT source_id, updated_at, map_extract(provider_metadata, 'feed_url')[1] AS feed_url, cardinality(provider_metadata) AS fields FROM canonical_item)
SELECT feed_url, fields::INT AS fields FROM i WHERE feed_url <> '' QUALIFY row_number() OVER (PARTITION BY feed_url ORDER BY updated_at DESC NULLS LAST, source_id DESC) = 1""")
def feed_metadata(spark, d):
    return items.feed_metadata(_items(spark, d).select("source_id", "updated_at", "provider_metadata")).select("feed_url", F.size("provider_metadata").alias("fields"))


# --- runs ---------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT DISTINCT resource_revision_id, content_hash, title FROM resource_revision), q AS (SELECT resource_revision_id, content_hash AS fp, sha256(coalesce(title, '')) AS legacy FROM r),
runs AS (SELECT DISTINCT q.resource_revision_id, coalesce(consecutive_failures, 0) = 0 AS present FROM fetch_capture f JOIN q ON f.resource_revision_id = q.resource_revision_id WHERE coalesce(warning, '') = '')
SELECT CASE WHEN EXISTS (SELECT 1 FROM runs WHERE runs.resource_revision_id = q.resource_revision_id AND present) THEN 'current' WHEN EXISTS (SELECT 1 FROM runs WHERE runs.resource_revision_id = q.resource_revision_id AND NOT present) THEN 'legacy' END AS reused, count(*) AS requests FROM q GROUP BY 1""")
def cached_results(spark, d):
    """Requests for all revisions, and which of them an earlier run has answered, by the present key or the one before it."""
    r = table(spark, d, "resource_revision").select("resource_revision_id", "content_hash", "title").distinct()
    fixed = [F.lit(c).alias(c) for c in runs.CACHE_KEY[1:]]
    legacy = F.sha2(F.coalesce("title", F.lit("")), 256)
    requests = r.select("resource_revision_id", *fixed, F.col("content_hash").alias("fingerprint"), legacy.alias("legacy_fingerprint"))
    present = F.coalesce("consecutive_failures", F.lit(0)) == 0
    done = table(spark, d, "fetch_capture").join(r, "resource_revision_id").select(
        "resource_revision_id", *fixed, F.when(present, F.col("content_hash")).otherwise(legacy).alias("fingerprint"), F.when(present, 2).otherwise(1).alias("fingerprint_version"),
        F.when(F.coalesce("warning", F.lit("")) == "", "completed").otherwise("failed").alias("status"), F.col("fetched_at").alias("finished_at"), F.col("fetch_capture_id").alias("run_id"), F.lit("{}").alias("result"),
    )
    return runs.reusable(requests, done).groupBy("reused").agg(F.count("*").alias("requests"))


@query(f"""WITH i AS (SELECT source_id, min({_canonical_sql('url')}) AS url FROM canonical_item GROUP BY 1), w AS (SELECT *, CASE WHEN coalesce(url, '') = '' THEN 1 ELSE row_number() OVER (PARTITION BY url ORDER BY source_id) END AS wave FROM i)
SELECT source_id, wave, (row_number() OVER (PARTITION BY wave ORDER BY source_id) - 1) // 50 AS part FROM w""")
def item_chunks(spark, d):
    """Items in chunks of up to 50, no resource twice in one."""
    i = _items(spark, d).select("source_id", urls.canonical_url("url").alias("url")).groupBy("source_id").agg(F.min("url").alias("url"))
    return runs.chunks(i, "url", [F.col("source_id")], 50).select("source_id", "wave", "part")


@query("""WITH r AS (SELECT doc_id, sum(CASE WHEN lang = 'ja' THEN 1 ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) SELECT doc_id FROM r WHERE coalesce(before, 0) < 100""")
def until_new(spark, d):
    """Deliveries up to the hundredth that is new; the others are known."""
    return runs.up_to_new(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], F.col("lang") == "ja", 100).select("doc_id")


@query("""WITH c AS (SELECT CASE WHEN lang = 'de' THEN 'current' END AS reused, coalesce(n_chars, 0) // 4 AS t FROM documents)
SELECT count(*) FILTER (WHERE reused IS NULL) AS new_requests, count(reused) AS reusable, coalesce(sum(t) FILTER (WHERE reused IS NULL), 0)::BIGINT AS tokens_in, coalesce(sum(least(round_even(t * 0.25, 0), 800)) FILTER (WHERE reused IS NULL), 0)::BIGINT AS tokens_out FROM c""")
def plan_totals(spark, d):
    """Requests and tokens of a plan over all documents, of which some have a result already."""
    c = table(spark, d, "documents").select(F.when(F.col("lang") == "de", "current").alias("reused"), F.floor(F.coalesce("n_chars", F.lit(0)) / 4).alias("tokens_in"), F.lit(0.25).alias("ratio"))
    return runs.plan_totals(c)
