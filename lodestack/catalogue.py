"""Queries of the archive's own operators, by name, with SQL that says the same.

Every query runs over its whole tables.  ``NOW`` is fixed so that both sides mean the same
instant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import html, json, quality, text, times, urls
from .operators import checks, diversity, identity, latest, lookup, merge, ranks, render, sampling, search, snapshot
from .plans import refresh
from .runtime import table, tune
from .sources import bookmarks, feeds, providers

NOW = "2026-10-01 00:00:00"
ARCHIVE = ("canonical_item", "comment_revision", "resource_revision", "page_fetch", "payload", "fetch_capture", "documents")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# RE2 has no \p{White_Space}; this is the class that the JVM side uses.
_W = r"[\s\x0B\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_URL = urls.URL_PATTERN


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _canonical_sql(x: str) -> str:
    g = lambda i: f"regexp_extract(trim({x}), '{_URL}', {i})"
    s, p = f"lower({g(1)})", g(3)
    return (
        f"CASE WHEN {x} IS NULL THEN NULL WHEN {g(2)} = '' THEN trim({x}) ELSE {s} || '://' || translate(lower({g(2)}), '[]', '') || "
        f"CASE WHEN {p} = '' OR ({s} = 'http' AND {p} = '80') OR ({s} = 'https' AND {p} = '443') THEN '' ELSE ':' || {p} END || "
        f"CASE WHEN {g(4)} = '' THEN '/' ELSE {g(4)} END || CASE WHEN {g(5)} = '?' THEN '' ELSE {g(5)} END END"
    )


def _instant_sql(x: str) -> str:
    return (
        f"coalesce(epoch(try_cast(CASE WHEN regexp_full_match(trim({x}), '\\d{{4}}-\\d{{2}}-\\d{{2}}T.*') THEN trim({x}) END AS TIMESTAMPTZ))::BIGINT, "
        f"epoch(try_strptime(regexp_replace(regexp_replace(trim({x}), '^[A-Za-z]{{3}},\\s*', ''), '\\s(GMT|UT|UTC|Z)$', ''), '%d %b %Y %H:%M:%S'))::BIGINT)"
    )


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tune(spark), sf_dir)
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "canonical_item")


# --- identity ---------------------------------------------------------------------------


@query(f"SELECT DISTINCT source_id, url, {_canonical_sql('url')} AS canonical_url, lower(regexp_extract(trim(url), '{_URL}', 2)) AS host, 'url:' || sha256({_canonical_sql('url')}) AS key FROM canonical_item")
def canonical_url(spark, d):
    return _items(spark, d).select("source_id", "url", urls.canonical_url("url").alias("canonical_url"), urls.url_host("url").alias("host"), urls.content_key("url").alias("key")).distinct()


@query(f"SELECT source, count(*) AS rows, count(*) FILTER (WHERE content_key = 'url:' || sha256({_canonical_sql('url')})) AS agreeing FROM canonical_item GROUP BY source")
def content_key_agreement(spark, d):
    """The keys in the data are those that their URLs have."""
    return _items(spark, d).groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("content_key") == urls.content_key("url")).alias("agreeing"))


@query(f"""WITH c AS (SELECT source_id, url, {_canonical_sql('url')} AS canonical_url FROM canonical_item)
SELECT canonical_url, count(DISTINCT source_id) AS items, count(DISTINCT url) AS spellings, min(source_id) AS first_item FROM c WHERE canonical_url IS NOT NULL GROUP BY canonical_url""")
def shared_resources(spark, d):
    return identity.shared_resources(_items(spark, d), "source_id", "url")


@query(f"""WITH known AS (SELECT DISTINCT {_canonical_sql('url')} AS c FROM page_fetch), items AS (SELECT DISTINCT source_id, source, {_canonical_sql('url')} AS c FROM canonical_item)
SELECT source, known.c IS NULL AS is_new, count(*) AS items, count(DISTINCT items.c) AS resources FROM items LEFT JOIN known ON items.c = known.c GROUP BY ALL""")
def resolve_resources(spark, d):
    known = table(spark, d, "page_fetch").select(urls.canonical_url("url").alias("canonical_url")).distinct().withColumn("resource_id", F.concat(F.lit("known-"), F.sha2("canonical_url", 256)))
    items = _items(spark, d).select("source_id", "source", urls.canonical_url("url").alias("url")).distinct()
    got = identity.resolve(items, known, "source_id", "url")
    return got.groupBy("source", "is_new").agg(F.count("*").alias("items"), F.count_distinct("resource_id").alias("resources"))


@query(f"SELECT DISTINCT url, 'rss-' || substr(sha256(coalesce(map_extract(provider_metadata, 'feed_url')[1], '') || chr(0) || url), 1, 20) AS feed_source_id, 'hatena-' || substr(sha256({_canonical_sql('url')}), 1, 16) AS short_source_id FROM canonical_item")
def source_ids(spark, d):
    feed = F.coalesce(F.try_element_at("provider_metadata", F.lit("feed_url")), F.lit(""))
    return _items(spark, d).select("url", urls.feed_source_id(feed, "url").alias("feed_source_id"), urls.short_source_id("hatena", "url").alias("short_source_id")).distinct()


# --- instants ----------------------------------------------------------------------------


@query(f"SELECT DISTINCT source_id, created_at, {_instant_sql('created_at')} AS created, {_instant_sql('updated_at')} AS updated FROM canonical_item")
def parse_instants(spark, d):
    return _items(spark, d).select("source_id", "created_at", times.epoch_seconds("created_at").alias("created"), times.epoch_seconds("updated_at").alias("updated")).distinct()


@query(r"""SELECT DISTINCT source_id, CASE WHEN regexp_matches(trim(created_at), '^\d{4}-\d{2}') THEN replace(substr(trim(created_at), 1, 7), '-', '/')
ELSE strftime(try_strptime(regexp_extract(created_at, '(\d{1,2} [A-Za-z]{3} \d{4})', 1), '%d %b %Y'), '%Y/%m') END AS month FROM canonical_item""")
def own_months(spark, d):
    return _items(spark, d).select("source_id", times.own_year_month("created_at").alias("month")).distinct()


# --- latest states, ranks, streaks --------------------------------------------------------


@query(f"""WITH r AS (SELECT source_id, updated_at, excerpt, comment, row_number() OVER (PARTITION BY source_id ORDER BY {_instant_sql('updated_at')} DESC NULLS LAST, coalesce(excerpt, '') DESC, coalesce(comment, '') DESC) AS i FROM canonical_item)
SELECT source_id, updated_at, excerpt, comment FROM r WHERE i = 1""")
def latest_item_state(spark, d):
    rows = _items(spark, d).select("source_id", "updated_at", "excerpt", "comment")
    order = [times.epoch_seconds("updated_at"), F.coalesce("excerpt", F.lit("")), F.coalesce("comment", F.lit(""))]
    return latest.latest_by_key(rows, ["source_id"], order).select("source_id", "updated_at", "excerpt", "comment")


@query("""WITH r AS (SELECT resource_id, page_fetch_id, http_status, failure_kind, row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC, page_fetch_id DESC) AS i FROM page_fetch)
SELECT resource_id, page_fetch_id, http_status, failure_kind FROM r WHERE i = 1""")
def latest_fetch(spark, d):
    rows = table(spark, d, "page_fetch").select("resource_id", "page_fetch_id", "http_status", "failure_kind", "fetched_at")
    return latest.latest_by_key(rows, ["resource_id"], [F.col("fetched_at"), F.col("page_fetch_id")]).drop("fetched_at")


@query("""WITH r AS (SELECT resource_id, page_fetch_id, row_number() OVER (PARTITION BY resource_id ORDER BY coalesce(length(text), 0) > 0 DESC, fetched_at DESC, page_fetch_id DESC) AS i FROM page_fetch)
SELECT resource_id, page_fetch_id FROM r WHERE i = 1""")
def keep_best_fetch(spark, d):
    rows = table(spark, d, "page_fetch").select("resource_id", "page_fetch_id", "fetched_at", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("full"))
    return latest.latest_by_key(rows, ["resource_id"], [F.col("full"), F.col("fetched_at"), F.col("page_fetch_id")]).select("resource_id", "page_fetch_id")


def _attempts(spark, d) -> DataFrame:
    """Distinct attempts with whether they failed or brought content."""
    rows = table(spark, d, "page_fetch").select(
        "resource_id", "page_fetch_id", "fetched_at", "http_status", "failure_kind", F.coalesce("error", F.lit("")).alias("warning"),
        (~text.is_blank("text")).alias("full"),
    ).distinct()
    return rows


_ATTEMPTS_SQL = f"""attempts AS (SELECT DISTINCT resource_id, page_fetch_id, fetched_at, http_status, failure_kind, coalesce(error, '') AS warning, {_strip_sql("coalesce(text, '')")} <> '' AS "full" FROM page_fetch),
islands AS (SELECT *, sum(CASE WHEN "full" AND NOT (NOT "full" AND warning <> '') THEN 1 ELSE 0 END) OVER (PARTITION BY resource_id ORDER BY fetched_at, page_fetch_id ROWS UNBOUNDED PRECEDING) AS island FROM attempts),
streaks AS (SELECT *, sum(CASE WHEN NOT "full" AND warning <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY resource_id, island ORDER BY fetched_at, page_fetch_id ROWS UNBOUNDED PRECEDING)::INT AS streak FROM islands)"""


def _streaks(spark, d) -> DataFrame:
    a = _attempts(spark, d)
    failed = ~F.col("full") & (F.col("warning") != "")
    # months cut the windows of resources that are fetched very often
    return latest.failure_streaks(a, "resource_id", [F.col("fetched_at"), F.col("page_fetch_id")], failed, F.col("full"), F.date_format("fetched_at", "yyyy-MM"))


@query(f"WITH {_ATTEMPTS_SQL} SELECT page_fetch_id, streak FROM streaks")
def failure_streak(spark, d):
    return _streaks(spark, d).select("page_fetch_id", "streak")


@query(f"""WITH {_ATTEMPTS_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC, page_fetch_id DESC) AS i FROM streaks) WHERE i = 1),
ages AS (SELECT *, date_diff('microsecond', fetched_at, TIMESTAMP '{NOW}') / 60000000.0 AS age FROM last)
SELECT resource_id, streak, coalesce(CASE WHEN NOT (warning <> '' AND NOT "full") THEN age >= 30 * 1440 WHEN http_status IN (404, 410) THEN false
WHEN failure_kind IN ('dns', 'timeout') AND streak >= 3 THEN false WHEN streak = 0 THEN true ELSE age >= least(30.0 * pow(2.0, least(streak - 1, 62)), 43200.0) END, false) AS due FROM ages""")
def fetch_due(spark, d):
    last = latest.latest_by_key(_streaks(spark, d), ["resource_id"], [F.col("fetched_at"), F.col("page_fetch_id")])
    captures = last.withColumn("has_payload", F.lit(False)).withColumn("body", F.when(F.col("full"), "x").otherwise("")).withColumn("failures", F.col("streak"))
    now = F.lit(NOW).cast("timestamp")
    return refresh.due(captures, now, 30, (404, 410), ("dns", "timeout"), 3, 30, 30).select("resource_id", "streak", "due")


@query(f"""WITH {_ATTEMPTS_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC, page_fetch_id DESC) AS i FROM streaks) WHERE i = 1)
SELECT resource_id, row_number() OVER (ORDER BY fetched_at ASC NULLS FIRST, resource_id) AS place FROM last WHERE NOT "full" QUALIFY place <= 500""")
def unfetched_backlog(spark, d):
    """The oldest resources without a body, up to the size of a run."""
    last = latest.latest_by_key(_attempts(spark, d), ["resource_id"], [F.col("fetched_at"), F.col("page_fetch_id")])
    rows = last.where(~F.col("full")).select("resource_id", "fetched_at")
    return latest.first_rows(rows, [F.col("fetched_at").asc_nulls_first(), F.col("resource_id")], 500).select("resource_id", F.col("seq").cast("long").alias("place"))


_USER = "json_extract_string(metadata_json, '$.user')"


@query(f"""WITH r AS (SELECT DISTINCT {_USER} AS user, comment_revision_id, star_count, posted_at FROM comment_revision WHERE {_USER} IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY coalesce(star_count, 0) DESC, posted_at ASC NULLS LAST, comment_revision_id) AS rank FROM r)
SELECT user, comment_revision_id, rank FROM k WHERE rank <= 20""")
def comment_top20(spark, d):
    rows = table(spark, d, "comment_revision").select(json.text_at("metadata_json", "$.user").alias("user"), "comment_revision_id", "star_count", "posted_at").where("user is not null").distinct()
    order = [F.coalesce("star_count", F.lit(0)).desc(), F.col("posted_at").asc_nulls_last(), F.col("comment_revision_id")]
    return latest.top_n(rows, ["user"], order, 20).select("user", "comment_revision_id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH c AS (SELECT DISTINCT source_id, {_canonical_sql('url')} AS canonical_url FROM canonical_item)
SELECT source_id, row_number() OVER (PARTITION BY canonical_url ORDER BY source_id)::INT AS wave FROM c""")
def chunk_waves(spark, d):
    rows = _items(spark, d).select("source_id", urls.canonical_url("url").alias("canonical_url")).distinct()
    return latest.waves(rows, "canonical_url", [F.col("source_id")]).select("source_id", "wave")


@query("""WITH r AS (SELECT DISTINCT doc_id, source, url, published_at >= TIMESTAMP '2026-09-01' AS fresh FROM documents),
p AS (SELECT source, fresh, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS page FROM r),
g AS (SELECT source, page, coalesce(bool_or(fresh), false) AS news FROM p GROUP BY ALL),
i AS (SELECT *, sum(news::INT) OVER (PARTITION BY source ORDER BY page ROWS UNBOUNDED PRECEDING) AS island FROM g),
s AS (SELECT *, sum((NOT news)::INT) OVER (PARTITION BY source, island ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM i)
SELECT source, min(page) AS stop_page FROM s WHERE run >= 2 GROUP BY source""")
def known_page_stop(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "url", (F.col("published_at") >= F.lit("2026-09-01").cast("timestamp_ntz")).alias("fresh")).distinct()
    paged = ranks.row_numbers(rows, ["source"], [F.col("doc_id")], "page").withColumn("page", F.floor((F.col("page") - 1) / 5).cast("long"))
    pages = paged.groupBy("source", "page").agg(F.coalesce(F.bool_or("fresh"), F.lit(False)).alias("news"))
    return latest.first_stale_page(pages, "source", "page", F.col("news"), 2)


@query(f"""WITH r AS (SELECT DISTINCT source_id, {_instant_sql('created_at')} AS t FROM canonical_item)
SELECT source_id, t, row_number() OVER (ORDER BY t DESC NULLS LAST, source_id) AS place FROM r QUALIFY place <= 200""")
def newest_first(spark, d):
    rows = _items(spark, d).select("source_id", times.epoch_seconds("created_at").alias("t")).distinct()
    return latest.first_rows(rows, [F.col("t").desc_nulls_last(), F.col("source_id")], 200).select("source_id", "t", F.col("seq").cast("long").alias("place"))


@query("""WITH known AS (SELECT DISTINCT resource_id FROM fetch_capture), r AS (SELECT DISTINCT resource_id FROM page_fetch),
a AS (SELECT resource_id, 0 AS turn FROM r WHERE resource_id NOT IN (SELECT resource_id FROM known) ORDER BY resource_id LIMIT 150),
b AS (SELECT resource_id, 1 AS turn FROM r WHERE resource_id IN (SELECT resource_id FROM known) ORDER BY resource_id LIMIT 150)
SELECT resource_id, turn FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY turn, resource_id LIMIT 150""")
def shared_budget(spark, d):
    known = table(spark, d, "fetch_capture").select("resource_id").where("resource_id is not null").distinct()
    rows = table(spark, d, "page_fetch").select("resource_id").distinct()
    order = [F.col("resource_id")]
    return latest.shared_budget(rows.join(known, "resource_id", "left_anti"), rows.join(known, "resource_id", "left_semi"), order, order, 150)


# --- merges --------------------------------------------------------------------------------

_STATES = "SELECT source_id, coalesce(excerpt, '') AS excerpt, coalesce(comment, '') AS comment, coalesce(updated_at, '') AS updated_at, source FROM canonical_item"


def _states(spark, d) -> DataFrame:
    return _items(spark, d).select("source_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("excerpt", "comment", "updated_at")], "source")


def _two_states(spark, d) -> tuple[DataFrame, DataFrame]:
    pick = F.struct("updated_at", "excerpt", "comment")
    s = _states(spark, d)
    old = s.where("source <> 'rss'").groupBy("source_id").agg(F.min(pick).alias("s")).select("source_id", "s.*")
    new = s.where("source <> 'raindrop'").groupBy("source_id").agg(F.max(pick).alias("s")).select("source_id", "s.*")
    return old, new


@query(f"""WITH s AS ({_STATES}),
o AS (SELECT source_id, updated_at, excerpt, comment FROM s WHERE source <> 'rss' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at, excerpt, comment) = 1),
n AS (SELECT source_id, updated_at, excerpt, comment FROM s WHERE source <> 'raindrop' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, excerpt DESC, comment DESC) = 1)
SELECT coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN n.source_id IS NULL THEN o.excerpt ELSE n.excerpt END AS excerpt,
CASE WHEN o.source_id IS NULL THEN 'insert' WHEN n.source_id IS NULL THEN 'keep' WHEN o.excerpt = n.excerpt AND o.comment = n.comment AND o.updated_at = n.updated_at THEN 'unchanged' ELSE 'update' END AS action
FROM o FULL JOIN n ON o.source_id = n.source_id""")
def upsert_items(spark, d):
    old, new = _two_states(spark, d)
    return merge.upsert(old, new, ["source_id"], ["excerpt", "comment", "updated_at"]).select("source_id", "excerpt", "action")


@query(f"""WITH s AS ({_STATES}),
o AS (SELECT source_id, updated_at, excerpt, comment FROM s WHERE source <> 'rss' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at, excerpt, comment) = 1),
n AS (SELECT source_id, updated_at, excerpt, comment FROM s WHERE source <> 'raindrop' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, excerpt DESC, comment DESC) = 1),
once AS (SELECT source_id, updated_at, excerpt, comment FROM n UNION ALL SELECT source_id, updated_at, excerpt, comment FROM o WHERE source_id NOT IN (SELECT source_id FROM n))
SELECT CASE WHEN once.source_id IS NULL THEN 'insert' WHEN n.source_id IS NULL THEN 'keep' WHEN once.excerpt = n.excerpt AND once.comment = n.comment AND once.updated_at = n.updated_at THEN 'unchanged' ELSE 'update' END AS action, count(*) AS rows
FROM once FULL JOIN n ON once.source_id = n.source_id GROUP BY 1""")
def upsert_twice(spark, d):
    """A batch merged again changes nothing."""
    old, new = _two_states(spark, d)
    compare = ["excerpt", "comment", "updated_at"]
    once = merge.upsert(old, new, ["source_id"], compare).drop("action")
    return merge.upsert(once, new, ["source_id"], compare).groupBy("action").agg(F.count("*").alias("rows"))


@query("""WITH c AS (SELECT DISTINCT comment_id, body, star_count, created_at FROM comment_revision),
t AS (SELECT comment_id, body, star_count FROM c WHERE created_at < TIMESTAMP '2026-01-01'), b AS (SELECT comment_id, body, CASE WHEN created_at < TIMESTAMP '2025-09-01' THEN NULL ELSE star_count END AS star_count FROM c WHERE created_at >= TIMESTAMP '2025-07-01')
SELECT coalesce(t.comment_id, b.comment_id) AS comment_id, coalesce(b.star_count, t.star_count) AS star_count,
CASE WHEN t.comment_id IS NULL THEN 'insert' WHEN b.comment_id IS NULL THEN 'delete' ELSE 'unchanged' END AS action FROM t FULL JOIN b ON t.comment_id = b.comment_id""")
def replace_comments(spark, d):
    """A full refresh of comments; star counts that were not asked for are carried over."""
    c = table(spark, d, "comment_revision").select("comment_id", "body", "star_count", "created_at").distinct()
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    target = c.where(F.col("created_at") < at("2026-01-01")).select("comment_id", "body", "star_count")
    batch = c.where(F.col("created_at") >= at("2025-07-01")).select("comment_id", "body", F.when(F.col("created_at") >= at("2025-09-01"), F.col("star_count")).alias("star_count"))
    batch = merge.carry_over(target, batch, ["comment_id"], ["star_count"])
    return merge.upsert(target, batch, ["comment_id"], ["body", "star_count"], delete_missing=True).select("comment_id", "star_count", "action")


@query("""SELECT sha256(content) AS sha256, payload_id FROM (SELECT DISTINCT payload_id, content FROM payload) QUALIFY row_number() OVER (PARTITION BY sha256(content) ORDER BY payload_id) = 1""")
def put_payloads(spark, d):
    rows = table(spark, d, "payload").select("payload_id", "content")
    hashed = rows.select("payload_id", F.sha2("content", 256).alias("sha256"))  # contents stay where they are
    return merge.put_blobs(hashed.limit(0), hashed, "sha256", F.col("payload_id"), hashed=True).select("sha256", "payload_id")


@query("""SELECT DISTINCT payload_id FROM payload WHERE payload_id NOT IN (SELECT http_payload_id FROM fetch_capture WHERE http_payload_id IS NOT NULL AND http_status = 200 UNION SELECT rendered_payload_id FROM fetch_capture WHERE rendered_payload_id IS NOT NULL AND http_status = 200)""")
def orphan_payloads(spark, d):
    """Payloads that no successful capture refers to."""
    captures = table(spark, d, "fetch_capture").where("http_status = 200")
    return merge.orphans(table(spark, d, "payload").select("payload_id").distinct(), "payload_id", [(captures, "http_payload_id"), (captures, "rendered_payload_id")])


@query("""WITH c AS (SELECT DISTINCT resource_id, fetched_at, fetch_capture_id, http_payload_id FROM fetch_capture WHERE http_payload_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY fetched_at DESC, fetch_capture_id DESC) = 1)
SELECT c.resource_id, p.payload_id, p.byte_length FROM c JOIN (SELECT DISTINCT payload_id, media_type, byte_length FROM payload) p ON c.http_payload_id = p.payload_id WHERE lower(p.media_type) LIKE 'text/%'""")
def stored_payloads(spark, d):
    """The newest stored payload of each resource, of the text kinds."""
    caps = table(spark, d, "fetch_capture").where("http_payload_id is not null").select("resource_id", "fetched_at", "fetch_capture_id", "http_payload_id")
    last = latest.latest_by_key(caps, ["resource_id"], [F.col("fetched_at"), F.col("fetch_capture_id")]).select("resource_id", F.col("http_payload_id").alias("payload_id"))
    kinds = table(spark, d, "payload").select("payload_id", "media_type", "byte_length").distinct().where(F.lower("media_type").like("text/%"))
    return last.join(kinds, "payload_id").select("resource_id", "payload_id", "byte_length")


@query("""WITH f AS (SELECT DISTINCT fetch_capture_id, resource_id, resource_revision_id, http_payload_id, extracted_by FROM fetch_capture), r AS (SELECT DISTINCT resource_revision_id, length(content_markdown) AS n FROM resource_revision), p AS (SELECT DISTINCT payload_id, byte_length FROM payload)
SELECT extracted_by, count(*) AS captures, count(r.resource_revision_id) AS revisions, count(p.payload_id) AS payloads, sum(r.n)::BIGINT AS characters, sum(p.byte_length)::BIGINT AS bytes
FROM f LEFT JOIN r ON f.resource_revision_id = r.resource_revision_id LEFT JOIN p ON f.http_payload_id = p.payload_id GROUP BY extracted_by""")
def capture_joins(spark, d):
    f = table(spark, d, "fetch_capture").select("fetch_capture_id", "resource_revision_id", F.col("http_payload_id").alias("payload_id"), "extracted_by").distinct()
    r = table(spark, d, "resource_revision").select("resource_revision_id", F.length("content_markdown").alias("n"), F.lit(1).alias("has_r")).distinct()
    p = table(spark, d, "payload").select("payload_id", "byte_length", F.lit(1).alias("has_p")).distinct()
    j = f.join(r, "resource_revision_id", "left").join(p, "payload_id", "left")
    return j.groupBy("extracted_by").agg(F.count("*").alias("captures"), F.count("has_r").alias("revisions"), F.count("has_p").alias("payloads"), F.sum("n").cast("long").alias("characters"), F.sum("byte_length").alias("bytes"))


# --- tags, names, documents -----------------------------------------------------------------

_TAGS = "SELECT DISTINCT source_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM canonical_item"


@query(f"""WITH t AS ({_TAGS}), s AS (SELECT source_id, {_strip_sql('tag')} AS tag, i FROM t WHERE tag IS NOT NULL), k AS (SELECT source_id, tag, i FROM s WHERE tag <> '' QUALIFY row_number() OVER (PARTITION BY source_id, lower(tag) ORDER BY i) = 1)
SELECT source_id, tag, (row_number() OVER (PARTITION BY source_id ORDER BY i) - 1)::INT AS position FROM k""")
def unique_tags(spark, d):
    rows = _items(spark, d).select("source_id", "tags").distinct().select("source_id", text.unique_tags("tags").alias("tags"))
    return rows.select("source_id", F.posexplode("tags").alias("position", "tag"))


@query(rf"""WITH t AS (SELECT DISTINCT unnest(tags) AS tag FROM canonical_item)
SELECT tag, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({_strip_sql('tag')}, '^#+', '')), '{_W}+', '-', 'g'), '[^\p{{L}}\p{{N}}_/\-\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}]', '', 'g'), '^[-/]+|[-/]+$', '', 'g') AS normal FROM t WHERE tag IS NOT NULL""")
def normal_tags(spark, d):
    tags = _items(spark, d).select(F.explode("tags").alias("tag")).where("tag is not null").distinct()
    return tags.select("tag", text.normalize_tag("tag").alias("normal"))


@query(f"""WITH i AS (SELECT DISTINCT source_id, list_filter(coalesce(tags, []), lambda t: t IS NOT NULL AND t <> '') AS tags, title FROM canonical_item WHERE title IS NOT NULL)
SELECT source_id, array_to_string(list_transform(tags, lambda t: {_strip_sql('t')}), '|') AS tags, {_strip_sql('title')} AS rest FROM i""")
def bracket_comments(spark, d):
    """Tags and rest of comments that begin with their tags in brackets."""
    i = _items(spark, d).where("title is not null").select("source_id", F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")).alias("tags"), "title").distinct()
    comment = F.concat(F.array_join(F.transform("tags", lambda t: F.concat(F.lit("["), t, F.lit("]"))), ""), F.lit(" "), "title")
    c = i.select("source_id", comment.alias("comment"))
    return c.select("source_id", F.array_join(text.bracket_tags("comment"), "|").alias("tags"), text.bracket_rest("comment").alias("rest"))


_FILE = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(title, '')), '[^\p{L}\p{M}\p{N} \-_.]', ' ', 'g'), ' +', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"


@query(rf"""WITH f AS (SELECT DISTINCT source_id, coalesce(nullif(title, ''), nullif(url, ''), 'Untitled') AS title FROM (SELECT source_id, title, min(url) AS url FROM canonical_item GROUP BY ALL)), g AS (SELECT source_id, {_FILE} AS n FROM f),
s AS (SELECT source_id, CASE WHEN regexp_full_match(upper(n), 'CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]') THEN n || '_' ELSE n END AS n FROM g)
SELECT source_id, n AS name, coalesce(nullif(regexp_replace(substr(coalesce(nullif(n, ''), 'Untitled'), 1, 60), '[ .]+$', ''), ''), 'Untitled') || ' - ' || source_id || '.md' AS note FROM s""")
def note_names(spark, d):
    rows = _items(spark, d).groupBy("source_id", "title").agg(F.min("url").alias("url"))
    shown = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("url"), F.lit("")), F.lit("Untitled"))
    return rows.select("source_id", text.file_name(shown).alias("name"), text.note_name("title", "source_id", F.col("url")).alias("note"))


def _documents(spark, d) -> DataFrame:
    rows = table(spark, d, "resource_revision").select("resource_revision_id", "title", "content_markdown").distinct()
    fields = {"id": F.col("resource_revision_id"), "title": F.col("title")}
    doc = render.document(fields, F.coalesce("title", F.lit("")), F.col("content_markdown"))
    return rows.select(F.col("resource_revision_id").alias("item_id"), F.coalesce("title", F.lit("")).alias("title"), doc.alias("plain"))


def _yaml_sql(x: str) -> str:
    return f"""'"' || replace(replace(replace({x}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"'"""


_DOCS = f"""docs AS (SELECT DISTINCT resource_revision_id AS item_id, coalesce(title, '') AS title, concat_ws(chr(10), concat_ws(chr(10), '---', 'id: ' || {_yaml_sql('resource_revision_id')}, CASE WHEN title <> '' THEN 'title: ' || {_yaml_sql('title')} END, '---'),
chr(10) || '# ' || trim(replace(coalesce(title, ''), chr(10), ' ')) || chr(10), coalesce(content_markdown, '')) AS plain FROM resource_revision)"""
_SEALED = "'---' || chr(10) || 'managed: true' || chr(10) || 'render_hash: ' || sha256(plain) || chr(10) || substr(plain, 5)"


@query(f"WITH {_DOCS} SELECT item_id, sha256(plain) AS seal, length({_SEALED})::BIGINT AS length, sha256({_SEALED}) AS document_hash, sha256('---' || chr(10) || substr({_SEALED}, 97)) = regexp_extract({_SEALED}, 'render_hash: ([0-9a-f]+)', 1) AS untouched FROM docs")
def sealed_documents(spark, d):
    docs = _documents(spark, d).withColumn("document", render.sealed(F.col("plain")))
    return docs.select("item_id", render.seal_of(F.col("document")).alias("seal"), F.length("document").cast("long").alias("length"), F.sha2("document", 256).alias("document_hash"), render.is_untouched(F.col("document")).alias("untouched"))


@query(f"""WITH {_DOCS}, w AS (SELECT item_id, substr(item_id, 1, 4) || '/' || item_id || '.md' AS path, title, {_SEALED} AS document FROM docs),
e AS (SELECT item_id, CASE WHEN title LIKE 'W%' THEN 'old/' || item_id || '.md' ELSE path END AS path, CASE WHEN title LIKE 'T%' THEN document || ' ' ELSE document END AS document, title LIKE 'T%' AS touched FROM w WHERE title <> '')
SELECT w.item_id, w.path, CASE WHEN e.item_id IS NULL THEN 'written' WHEN e.touched THEN 'conflict' WHEN e.path <> w.path THEN 'moved' ELSE 'skipped' END AS action FROM w LEFT JOIN e ON w.item_id = e.item_id""")
def render_actions(spark, d):
    """A run over a folder with documents missing, changed by hand and laid out otherwise."""
    docs = _documents(spark, d)
    wanted = docs.select("item_id", F.concat(F.substring("item_id", 1, 4), F.lit("/"), "item_id", F.lit(".md")).alias("path"), "title", render.sealed(F.col("plain")).alias("document"))
    there = wanted.where("title <> ''").select(
        "item_id", F.when(F.col("title").startswith("W"), F.concat(F.lit("old/"), "item_id", F.lit(".md"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("title").startswith("T"), F.concat("document", F.lit(" "))).otherwise(F.col("document")).alias("document"),
    )
    return render.actions(wanted, there)


# --- texts ------------------------------------------------------------------------------------

_LEN = lambda x: f"length(regexp_replace(coalesce({x}, ''), '{_W}+', '', 'g'))::BIGINT"
_BARE = lambda x: f"regexp_replace(coalesce({x}, ''), '{_W}+', '', 'g')"
_LOST = lambda x: f"(length(coalesce({x}, '')) - length(replace(coalesce({x}, ''), '�', '')))::BIGINT"


@query(f"""WITH p AS (SELECT DISTINCT page_fetch_id, text, title FROM page_fetch), q AS (SELECT *, {_LEN('text')} AS n, {_LOST('text')} AS lost FROM p)
SELECT page_fetch_id, n AS length, lost, n >= 200 AND lost / greatest(length(coalesce(text, '')), 1) < 0.001 AS sure,
CASE WHEN coalesce(text, '') = '' THEN true WHEN lost / greatest(length(text), 1) >= 0.001 THEN true WHEN n >= 40 AND {_BARE('title')} <> '' AND contains({_BARE('text')}, {_BARE('title')}) THEN false WHEN n < 80 THEN true ELSE false END AS render FROM q""")
def text_quality(spark, d):
    p = table(spark, d, "page_fetch").select("page_fetch_id", "text", "title").distinct()
    return p.select("page_fetch_id", quality.compact_length("text").alias("length"), quality.lost_characters("text").alias("lost"), quality.high_confidence("text").alias("sure"), quality.needs_rendering("text", F.lit(""), "title").alias("render"))


@query(f"""WITH p AS (SELECT resource_id, max(page_fetch_id) AS id, arg_max(coalesce(text, ''), page_fetch_id) AS a FROM page_fetch GROUP BY 1), r AS (SELECT resource_id, arg_max(coalesce(content_markdown, ''), resource_revision_id) AS b FROM resource_revision GROUP BY 1),
j AS (SELECT resource_id, a, b, ({_LEN('a')} >= 200 AND {_LOST('a')} / greatest(length(a), 1) < 0.001) AS sa, ({_LEN('b')} >= 200 AND {_LOST('b')} / greatest(length(b), 1) < 0.001) AS sb FROM p JOIN r USING (resource_id))
SELECT resource_id, CASE WHEN (sb, -{_LOST('b')}, {_LEN('b')}) > (sa, -{_LOST('a')}, {_LEN('a')}) THEN sha256(b) ELSE sha256(a) END AS best, CASE WHEN a = '' THEN b <> '' ELSE {_LEN('a')} < 120 AND {_LEN('b')} >= 500 AND {_LEN('b')} >= {_LEN('a')} * 3 END AS prefer_recall FROM j""")
def better_text(spark, d):
    p = table(spark, d, "page_fetch").groupBy("resource_id").agg(F.max_by(F.coalesce("text", F.lit("")), "page_fetch_id").alias("a"))
    r = table(spark, d, "resource_revision").groupBy("resource_id").agg(F.max_by(F.coalesce("content_markdown", F.lit("")), "resource_revision_id").alias("b"))
    return p.join(r, "resource_id").select("resource_id", F.sha2(quality.better("a", "b"), 256).alias("best"), quality.prefer_recall("a", "b").alias("prefer_recall"))


@query(r"""SELECT resource_revision_id, sha256(regexp_replace(content_markdown, '(?im)^[ \t]*Advertisement[ \t]*$', '', 'g')) AS hash, length(regexp_replace(content_markdown, '(?im)^[ \t]*Advertisement[ \t]*$', '', 'g'))::BIGINT AS length
FROM (SELECT DISTINCT resource_revision_id, content_markdown FROM resource_revision)""")
def without_ads(spark, d):
    r = table(spark, d, "resource_revision").select("resource_revision_id", text.without_ads("content_markdown").alias("t")).distinct()
    return r.select("resource_revision_id", F.sha2("t", 256).alias("hash"), F.length("t").cast("long").alias("length"))


@query("""WITH i AS (SELECT DISTINCT source_id, lower(title) AS title, lower(excerpt) AS excerpt FROM canonical_item),
g AS (SELECT 'title' AS field, source_id, unnest(list_transform(range(1, greatest(length(title) - 1, 1)), lambda j: substr(title, j, 3))) AS gram FROM i WHERE length(title) >= 3
UNION ALL SELECT 'excerpt', source_id, unnest(list_transform(range(1, greatest(length(excerpt) - 1, 1)), lambda j: substr(excerpt, j, 3))) FROM i WHERE length(excerpt) >= 3)
SELECT field, count(DISTINCT source_id) AS documents, count(*) AS postings FROM (SELECT DISTINCT field, source_id, gram FROM g) GROUP BY field""")
def trigram_index(spark, d):
    docs = _items(spark, d).select("source_id", "title", "excerpt").distinct()
    return search.index_counts(search.build_index(docs, "source_id", ["title", "excerpt"]).distinct(), "source_id")


@query("SELECT DISTINCT source_id FROM canonical_item WHERE contains(lower(title), 'データ') OR contains(lower(title), 'archive')")
def trigram_search(spark, d):
    docs = _items(spark, d).select("source_id", "title").distinct()
    index = search.build_index(docs, "source_id", ["title"])
    return search.search(index, docs, "source_id", "title", "データ").unionByName(search.search(index, docs, "source_id", "title", "archive")).distinct()


# --- samples and topics -----------------------------------------------------------------------

_SIZES = "sizes AS (SELECT source, count(DISTINCT doc_id) AS size FROM documents GROUP BY source)"
_ALLOC = """t AS (SELECT *, count(*) OVER () AS k, least(700, sum(size) OVER ()) AS n FROM sizes), o AS (SELECT *, CASE WHEN n >= k THEN 1 ELSE 0 END AS one FROM t),
w AS (SELECT *, size - one AS w, n - one * k AS rest, sum(size - one) OVER () AS total FROM o), q AS (SELECT *, CASE WHEN total > 0 THEN rest * w // total ELSE 0 END AS q, CASE WHEN total > 0 THEN rest * w % total ELSE 0 END AS r FROM w),
l AS (SELECT *, rest - sum(q) OVER () AS left_over, row_number() OVER (ORDER BY r DESC, size DESC, source) AS i FROM q), alloc AS (SELECT source, size, (one + q + CASE WHEN i <= left_over THEN 1 ELSE 0 END)::BIGINT AS take FROM l)"""


@query(f"WITH {_SIZES}, {_ALLOC} SELECT source, size, take FROM alloc")
def sample_allocation(spark, d):
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count_distinct("doc_id").alias("size"))
    return sampling.allocate(sizes, "source", 700)


@query(f"""WITH {_SIZES}, {_ALLOC}, picks AS (SELECT source, (unnest(range(take)) * 2 + 1) * size // (take * 2) AS i FROM alloc WHERE take > 0),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM (SELECT DISTINCT doc_id, source FROM documents))
SELECT placed.doc_id, placed.source FROM placed JOIN picks ON placed.source = picks.source AND placed.i = picks.i""")
def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source").distinct()
    return sampling.stratified(docs, "source", [F.col("doc_id")], 700).select("doc_id", "source")


_GEN = "('article', 'bookmark', 'news', 'web', 'あとで読む', '未分類')"
_WORDS = f"list_transform(regexp_extract_all(coalesce(title, ''), '{diversity.TITLE_WORDS}', 1), lambda t: lower(t))"
_TOPICS = rf"""base AS (SELECT DISTINCT source_id, tags, title, url, excerpt FROM canonical_item), one AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY length(coalesce(excerpt, '')) DESC, coalesce(excerpt, '') DESC, url) = 1),
tagged AS (SELECT DISTINCT source_id, regexp_replace(regexp_replace(lower({_strip_sql('t')}), '^#+', ''), '{_W}+', '-', 'g') AS topic FROM (SELECT source_id, unnest(tags) AS t FROM one) WHERE t IS NOT NULL),
from_tags AS (SELECT * FROM tagged WHERE topic <> '' AND topic NOT IN {_GEN}),
words AS (SELECT source_id, unnest({_WORDS}) AS topic, generate_subscripts({_WORDS}, 1) AS i FROM one WHERE source_id NOT IN (SELECT source_id FROM from_tags)),
firsts AS (SELECT source_id, topic, min(i) AS i FROM words WHERE topic NOT IN {_GEN} GROUP BY ALL), from_title AS (SELECT source_id, topic FROM firsts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY i) <= 3),
from_host AS (SELECT source_id, regexp_replace(coalesce(nullif(lower(regexp_extract(trim(url), '{_URL}', 2)), ''), 'unknown'), '^www\.', '') AS topic FROM one WHERE source_id NOT IN (SELECT source_id FROM from_tags UNION SELECT source_id FROM from_title)),
topics AS (SELECT * FROM from_tags UNION ALL SELECT * FROM from_title UNION ALL SELECT * FROM from_host)"""


def _topics(spark, d) -> DataFrame:
    rows = _items(spark, d).select("source_id", "tags", "title", "url", "excerpt")
    body = F.coalesce("excerpt", F.lit(""))
    w = Window.partitionBy("source_id").orderBy(F.length(body).desc(), body.desc(), F.col("url"))
    one = rows.withColumn("__i", F.row_number().over(w)).where("__i = 1")
    return one.select("source_id", F.length(body).alias("n_body"), F.coalesce("title", F.lit("")).alias("title"), diversity.topics(F.col("tags"), F.col("title"), F.col("url")).alias("topics"))


@query(f"WITH {_TOPICS} SELECT topic, count(*) AS n FROM topics WHERE source_id NOT LIKE 'rss-%' GROUP BY topic")
def topic_counts(spark, d):
    """Topics of the records that are not covered yet; those of feeds count as covered."""
    return diversity.topic_counts(_topics(spark, d).where(~F.col("source_id").startswith("rss-")))


_CHOICE = """counts AS (SELECT topic, count(*) AS n FROM topics WHERE source_id NOT LIKE 'rss-%' GROUP BY topic), cov AS (SELECT DISTINCT topic FROM topics WHERE source_id LIKE 'rss-%'),
choice AS (SELECT t.source_id, t.topic FROM topics t JOIN counts c USING (topic) LEFT JOIN cov ON t.topic = cov.topic WHERE t.source_id NOT LIKE 'rss-%' QUALIFY row_number() OVER (PARTITION BY t.source_id ORDER BY c.n DESC, (cov.topic IS NULL) DESC, t.topic) = 1)"""


@query(f"WITH {_TOPICS}, {_CHOICE} SELECT source_id, topic FROM choice")
def chosen_topics(spark, d):
    rows = _topics(spark, d)
    covered = rows.where(F.col("source_id").startswith("rss-")).select(F.explode("topics").alias("topic"))
    rest = rows.where(~F.col("source_id").startswith("rss-"))
    return diversity.choose_topic(rest, "source_id", diversity.topic_counts(rest), covered)


@query(f"""WITH {_TOPICS}, {_CHOICE}, sizes AS (SELECT topic, n FROM counts WHERE topic IN (SELECT topic FROM choice)), ranks AS (SELECT s.topic, s.n, cov.topic IS NULL AS fresh, row_number() OVER (ORDER BY s.n DESC, cov.topic IS NOT NULL, s.topic) - 1 AS i FROM sizes s LEFT JOIN cov ON s.topic = cov.topic),
fresh AS (SELECT topic, row_number() OVER (ORDER BY n DESC, topic) - 1 AS j FROM ranks WHERE fresh), places AS (SELECT r.topic, least(2 * i, coalesce(2 * j + 1, 2 * i)) AS p FROM ranks r LEFT JOIN fresh f ON r.topic = f.topic),
ranked AS (SELECT c.source_id, c.topic, row_number() OVER (PARTITION BY c.topic ORDER BY length(coalesce(o.excerpt, '')) DESC, coalesce(o.title, ''), c.source_id) AS r FROM choice c JOIN one o USING (source_id))
SELECT source_id, ranked.topic AS topic, r::INT AS turn FROM ranked JOIN places ON ranked.topic = places.topic ORDER BY r, p LIMIT 300""")
def diverse_selection(spark, d):
    order = [F.col("n_body").desc(), F.col("title"), F.col("source_id")]
    return diversity.select_diverse(_topics(spark, d), "source_id", F.col("source_id").startswith("rss-"), order, 300)


# --- counts, JSON ---------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ARCHIVE))
def status_counts(spark, d):
    out = None
    for t in ARCHIVE:
        one = table(spark, d, t).agg(F.count("*").alias("rows")).select(F.lit(t).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT source, item_type, private, count(DISTINCT source_id) AS items, count(DISTINCT content_key) AS resources FROM canonical_item GROUP BY ALL")
def item_counts(spark, d):
    return _items(spark, d).groupBy("source", "item_type", "private").agg(F.count_distinct("source_id").alias("items"), F.count_distinct("content_key").alias("resources"))


@query(r"SELECT regexp_replace(warning, '\d+', '0', 'g') AS warning, count(DISTINCT fetch_capture_id) AS captures FROM fetch_capture WHERE warning <> '' GROUP BY 1")
def warning_histogram(spark, d):
    rows = table(spark, d, "fetch_capture").where("warning <> ''")
    return rows.groupBy(F.regexp_replace("warning", r"[0-9]+", "0").alias("warning")).agg(F.count_distinct("fetch_capture_id").alias("captures"))


@query(f"""SELECT {_USER} AS user, count(DISTINCT comment_revision_id) AS comments, max(try_cast(json_extract_string(metadata_json, '$.entry') AS BIGINT)) AS entry FROM comment_revision GROUP BY 1""")
def comment_users(spark, d):
    c = table(spark, d, "comment_revision").select("comment_revision_id", json.text_at("metadata_json", "$.user").alias("user"), json.number_at("metadata_json", "$.entry").alias("entry"))
    return c.groupBy("user").agg(F.count_distinct("comment_revision_id").alias("comments"), F.max("entry").alias("entry"))


@query("SELECT event_type, count(*) AS events, count(json_extract(props, '$.k')) AS with_k, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, round(sum(value) FILTER (WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) > 0) / sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)) FILTER (WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) > 0 AND value IS NOT NULL), 6) AS ratio FROM events GROUP BY event_type")
def event_ratio(spark, d):
    e = table(spark, d, "events").select("event_type", "value", json.number_at("props", "$.k").alias("k"))
    sums = e.groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("with_k"), F.sum("k").alias("k"))
    ratio = lookup.ratio(e, ["event_type"], F.col("value"), F.col("k"))
    return sums.join(ratio, "event_type", "left").select("event_type", "events", "with_k", sums["k"], F.round("ratio", 6).alias("ratio"))


@query("SELECT event_id, CAST(json_merge_patch(props, '{\"k\": null}') AS VARCHAR) AS rest, json_extract_string(props, '$.k') AS k FROM events")
def event_props(spark, d):
    return table(spark, d, "events").select("event_id", json.without_keys("props", "k").alias("rest"), json.text_at("props", "$.k").alias("k"))


@query("""SELECT DISTINCT payload_id, coalesce(json_extract_string(headers_json, '$."Content-Type"'), json_extract_string(headers_json, '$."content-type"')) AS content_type, json_extract_string(headers_json, '$.ETag') AS etag FROM payload""")
def payload_headers(spark, d):
    return table(spark, d, "payload").select("payload_id", json.header("headers_json", "content-type").alias("content_type"), json.header("headers_json", "etag").alias("etag")).distinct()


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Tumbling windows, an addition to the archive's own operators."""
    from .streaming.incremental import windowed_counts

    got = windowed_counts(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type", "1 day")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "events")


@query("""WITH c AS (SELECT DISTINCT comment_revision_id, json_extract_string(metadata_json, '$.user') AS user, star_count FROM comment_revision), u AS (SELECT user, max(star_count) AS stars FROM c WHERE user IS NOT NULL AND star_count > 50 GROUP BY user)
SELECT DISTINCT c.comment_revision_id, coalesce(u.stars, 0) AS stars FROM c LEFT JOIN u ON c.user = u.user WHERE c.user IS NOT NULL""")
def looked_up_stars(spark, d):
    """Comments with a count looked up by user, nought where there is none."""
    c = table(spark, d, "comment_revision").select("comment_revision_id", json.text_at("metadata_json", "$.user").alias("user"), "star_count").where("user is not null").distinct()
    known = c.where("star_count > 50").select("user", F.col("star_count").alias("stars"))
    return lookup.with_default(c.select("comment_revision_id", "user"), known, "user", "stars", 0).select("comment_revision_id", "stars").distinct()


@query(f"""WITH s AS ({_STATES}),
o AS (SELECT source_id, source, updated_at, excerpt, comment FROM s WHERE source <> 'rss' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at, excerpt, comment) = 1),
n AS (SELECT source_id, source, updated_at, excerpt, comment FROM s WHERE source <> 'raindrop' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY updated_at DESC, excerpt DESC, comment DESC) = 1),
a AS (SELECT split_part(coalesce(o.source_id, n.source_id), '-', 1) AS kind, CASE WHEN o.source_id IS NULL THEN 'insert' WHEN n.source_id IS NULL THEN 'keep' WHEN o.excerpt = n.excerpt AND o.comment = n.comment AND o.updated_at = n.updated_at THEN 'unchanged' ELSE 'update' END AS action FROM o FULL JOIN n ON o.source_id = n.source_id)
SELECT CASE WHEN kind IN ('rss', 'hatena') THEN kind ELSE 'other' END AS kind, count(*) AS processed, count(*) FILTER (action = 'insert') AS "insert", count(*) FILTER (action = 'update') AS "update", count(*) FILTER (action = 'unchanged') AS unchanged, count(*) FILTER (action = 'keep') AS keep, count(*) FILTER (action = 'delete') AS "delete" FROM a GROUP BY 1""")
def run_report(spark, d):
    """What a merge did, by source."""
    old, new = _two_states(spark, d)
    got = merge.upsert(old, new, ["source_id"], ["excerpt", "comment", "updated_at"])
    kind = F.substring_index("source_id", "-", 1)
    return lookup.outcome_report(got.withColumn("kind", F.when(kind.isin("rss", "hatena"), kind).otherwise("other")), ["kind"])


@query("""SELECT 'captures without their payload' AS "check", count(*) AS violations FROM (SELECT DISTINCT fetch_capture_id, http_payload_id FROM fetch_capture) WHERE http_payload_id IS NOT NULL AND http_payload_id NOT IN (SELECT payload_id FROM payload)
UNION ALL SELECT 'captures without their revision', count(*) FROM (SELECT DISTINCT fetch_capture_id, resource_revision_id FROM fetch_capture) WHERE resource_revision_id IS NOT NULL AND resource_revision_id NOT IN (SELECT resource_revision_id FROM resource_revision)
UNION ALL SELECT 'deliveries of an item', count(*) FROM (SELECT source_id FROM canonical_item GROUP BY source_id HAVING count(*) > 1)
UNION ALL SELECT 'items in several states', count(*) FROM (SELECT source_id FROM canonical_item GROUP BY source_id HAVING count(DISTINCT concat_ws('|', coalesce(excerpt, ''), coalesce(comment, ''), coalesce(updated_at, ''))) > 1)""")
def constraint_report(spark, d):
    captures = table(spark, d, "fetch_capture").select("fetch_capture_id", "http_payload_id", "resource_revision_id").distinct()
    items = _states(spark, d)
    return checks.report({
        "captures without their payload": checks.dangling(captures, "http_payload_id", table(spark, d, "payload"), "payload_id"),
        "captures without their revision": checks.dangling(captures, "resource_revision_id", table(spark, d, "resource_revision"), "resource_revision_id"),
        "deliveries of an item": checks.repeated_keys(items, ["source_id"]),
        "items in several states": checks.conflicting_rows(items, "source_id", ["excerpt", "comment", "updated_at"]),
    })


@query(f"""WITH a AS (SELECT source_id, max(title) AS title FROM canonical_item WHERE source = 'hatena' GROUP BY 1), b AS (SELECT source_id, max(title) AS title FROM canonical_item WHERE source <> 'raindrop' GROUP BY 1)
SELECT coalesce(a.source_id, b.source_id) AS source_id, coalesce(CASE WHEN a.source_id IS NOT NULL THEN a.title ELSE b.title END, '') AS title, CASE WHEN a.source_id IS NOT NULL THEN 'first' ELSE 'second' END AS source FROM a FULL JOIN b ON a.source_id = b.source_id""")
def union_of_sources(spark, d):
    """Two overlapping sources as one; the first wins."""
    one = lambda df, name: providers.as_item(df.groupBy("source_id").agg(F.max("title").alias("title")), source=F.lit(name), source_id=F.col("source_id"), title=F.col("title"))
    a, b = _items(spark, d).where("source = 'hatena'"), _items(spark, d).where("source <> 'raindrop'")
    return providers.union_sources([one(a, "first"), one(b, "second")]).select("source_id", "title", "source")


@query(f"""SELECT source_id, source, coalesce(url, '') AS url, coalesce(title, '') AS title, coalesce(created_at, '') AS created_at, coalesce(lower(regexp_extract(trim(url), '{_URL}', 2)), '') AS domain FROM (SELECT DISTINCT source_id, source, url, title, created_at FROM canonical_item)""")
def metadata_round_trip(spark, d):
    """Items as maps of their fields, and back."""
    i = _items(spark, d).select("source_id", "source", "url", "title", "created_at").distinct().withColumns({c: F.lit("") for c in ("excerpt", "comment", "updated_at", "item_type")})
    back = providers.from_metadata(providers.metadata(i), "raindrop").select("source_id", "source", "url", "title", "created_at")
    return back.withColumn("domain", F.coalesce(urls.url_host("url"), F.lit("")))


@query("""SELECT resource_id, (row_number() OVER (PARTITION BY resource_id ORDER BY first) - 1)::INT AS position, url FROM (SELECT resource_id, trim(url) AS url, min(page_fetch_id) AS first FROM page_fetch WHERE trim(url) <> '' GROUP BY ALL)""")
def replaced_children(spark, d):
    """URLs that each resource was fetched under, in order of first appearance."""
    batch = table(spark, d, "page_fetch").groupBy("resource_id", "url").agg(F.min("page_fetch_id").alias("first"))
    none = batch.limit(0).select("resource_id", "url", F.lit(0).alias("position"))
    return merge.replace_children(none, batch, "resource_id", "url", [F.col("first")]).select("resource_id", "position", "url")


# --- pages, feeds, exports -----------------------------------------------------------------------


@query()
def page_parts(spark, d):
    """Title, text, links and images of stored pages, decoded by header, mark or own word."""
    rows = table(spark, d, "payload").where(F.col("media_type").rlike("html")).select("payload_id", "source_url", html.page_text("content", "charset").alias("html"))
    parts = rows.select("payload_id", html.page_parts("html", "source_url").alias("p"))
    return parts.select("payload_id", "p.title", F.length("p.text").cast("long").alias("length"), F.size("p.links").alias("links"), F.size("p.images").alias("images")).distinct()


_XML = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query(rf"""SELECT DISTINCT source_id AS native_id, url, trim(regexp_replace(coalesce(title, ''), '{_W}+', ' ', 'g')) AS title FROM canonical_item WHERE source = 'rss' AND url IS NOT NULL""")
def feed_entries(spark, d):
    """Feeds of one entry each, written from items and read again."""
    i = _items(spark, d).where("source = 'rss' and url is not null").select("source_id", "url", "title").distinct()
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title><item><guid isPermaLink="false">'), _xml(F.col("source_id")), F.lit("</guid><link>"), _xml(F.col("url")),
        F.lit("</link><title>"), _xml(_xml(F.coalesce("title", F.lit("")))), F.lit("</title></item></channel></rss>"),
    )
    got = feeds.entries(i.select(F.lit("https://feed.test/").alias("feed_url"), body.alias("body")))
    return got.select("native_id", "url", "title")


@query(rf"""SELECT DISTINCT source_id AS file, url, trim(regexp_replace(coalesce(title, ''), '{_W}+', ' ', 'g')) AS title, coalesce(private, false) AS private FROM canonical_item WHERE url IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY source_id, url ORDER BY coalesce(title, ''), coalesce(private, false)) = 1""")
def exported_items(spark, d):
    """Bookmark files of one item each, written and read again."""
    i = _items(spark, d).where("url is not null").groupBy("source_id", "url").agg(F.min(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("private", F.lit(False)).alias("private"))).alias("t")).select("source_id", "url", "t.*")
    body = F.concat(F.lit('<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><p><DT><A HREF="'), _xml(F.col("url")), F.lit('" PRIVATE="'), F.when(F.col("private"), "1").otherwise("0"), F.lit('">'), _xml(F.coalesce("title", F.lit(""))), F.lit("</A></DL>"))
    got = bookmarks.exported_items(i.select(F.col("source_id").alias("file"), body.alias("body")))
    return got.select("file", "url", "title", "private")


@query()
def snapshot_manifest(spark, d):
    return snapshot.manifest({t: table(spark, d, t) for t in ARCHIVE})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
