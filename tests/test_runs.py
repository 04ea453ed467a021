"""Fetches, comments, items and runs on small tables."""

from pyspark.sql import functions as F

from lodestack.operators import comments, items, pages
from lodestack.plans import runs


def _captures(spark, rows):
    return spark.createDataFrame(rows, pages.CAPTURE)


def test_fetches_by_outcome(spark):
    cap = lambda r, rev, fails, kind, **k: (r, f"c-{r}", rev, k.get("payload"), None, "https://old.test/", "x", False, k.get("warning"), "e0", "l0", fails, k.get("status"), kind, None)
    captures = _captures(spark, [cap("page", "r1", 3, "dns", warning="w"), cap("blank", "r2", 2, "dns"), cap("fail", "r3", 1, None, payload="p"), cap("detach", "r4", 0, None), cap("same", "r5", 4, "dns", warning="w"), cap("idle", "r6", 7, "dns", status=404)])
    revisions = spark.createDataFrame([(r, f"r{i}", "t", b, "", None) for i, (r, b) in enumerate([("page", "old"), ("blank", "old"), ("fail", "body"), ("detach", " "), ("same", "body"), ("idle", "body")], 1)], "resource_id string, resource_revision_id string, title string, content_markdown string, discussion_text string, created_at timestamp")
    new = spark.createDataFrame(
        [("page", "page", "new", "t", None, "https://new.test/", 200, None, None), ("blank", "page", " ", "t", None, "u", 200, None, None), ("fail", "failed", None, None, "boom", "", None, "timeout", None), ("detach", "failed", None, None, "boom", "u", 500, None, None), ("same", "same", None, None, None, "u", 304, None, ""), ("new", "page", "first", "t", None, "u", 200, None, "e"), ("gone", "failed", None, None, "boom", "u", 404, None, None), ("void", "same", None, None, None, "u", 304, None, None)],
        "resource_id string, outcome string, content_markdown string, title string, warning string, final_url string, http_status int, failure_kind string, response_etag string",
    ).withColumn("at", F.lit("2026-01-01").cast("timestamp"))
    after, revised = pages.record_fetches(captures, revisions, new)
    c = {r["resource_id"]: r for r in after.collect()}
    got = {k: (r["consecutive_failures"], r["http_status"], r["failure_kind"], r["warning"], r["final_url"], r["http_payload_id"], r["response_etag"]) for k, r in c.items()}
    assert got == {
        "page": (0, 200, None, None, "https://new.test/", None, None), "blank": (2, 200, "dns", None, "u", None, None), "fail": (2, None, "timeout", "boom", "https://old.test/", "p", None), "detach": (1, 500, None, "boom", "u", None, None),
        "same": (0, 304, None, None, "u", None, "e0"), "idle": (7, 404, "dns", None, "https://old.test/", None, "e0"), "new": (0, 200, None, None, "u", None, "e"), "gone": (1, 404, None, "boom", "u", None, None),
    }
    actions = {r["resource_id"]: r["action"] for r in revised.collect()}
    assert actions == {"page": "update", "blank": "update", "fail": "keep", "detach": "detach", "same": "keep", "idle": "keep", "new": "insert"}
    assert c["page"]["resource_revision_id"] == "r1" and c["new"]["resource_revision_id"] == revised.where("resource_id = 'new'").first()["resource_revision_id"]
    again = pages.record_fetches(after, revised.where("action <> 'detach'").drop("action"), new.where("resource_id = 'page'"))[1]
    assert {r["action"] for r in again.collect()} == {"unchanged", "keep"}
    assert pages.record_fetches(captures.limit(0), revisions.limit(0), new.limit(0))[0].count() == 0
    assert pages.terminal(captures, revisions, (), ()).count() == 0


def test_conditional_state_and_warnings(spark):
    old = spark.createDataFrame([("a", "e", "l"), ("b", "e", "l")], "feed_url string, etag string, last_modified string")
    new = spark.createDataFrame([("a", 304, "", None), ("b", 500, "x", "y"), ("c", 200, "e2", None)], "feed_url string, http_status int, etag string, last_modified string")
    assert sorted(map(tuple, pages.conditional_state(old, new).collect()), key=str) == [("a", "e", "l"), ("b", "e", "l"), ("c", "e2", None)]
    assert [r[0] for r in spark.range(1).select(pages.merged_warning(F.lit("a"), F.lit(None).cast("string"), F.lit(""), F.lit("b"))).collect()] == ["a; b"]


def test_refresh_of_comments(spark):
    targets = spark.createDataFrame([("r1", "u1"), ("r2", "u2"), ("r3", "u3")], "resource_id string, url string")
    counts = spark.createDataFrame([("u1", 3), ("u2", 5)], "url string, count int")
    state = spark.createDataFrame([("hatena", "r1", 3, "", "9", None), ("hatena", "r2", 4, "", "9", None), ("hatena", "r3", 1, "", "9", None)], "provider string, resource_id string, bookmark_count int, entry_url string, entry_id string, checked_at timestamp")
    assert sorted(r["resource_id"] for r in comments.due(targets, counts, state).collect()) == ["r2", "r3"] and comments.due(targets, counts, state, force=True).count() == 3
    said = [("r2", f"user-{i:02}", "b", "[]", f"2026-01-{i + 1:02}", "{}", "9") for i in range(25)] + [("r1", "user-00", "b", "[]", "", "{}", "9"), ("r2", "", "b", "[]", "", "{}", "9")]
    talk = spark.createDataFrame(said, "resource_id string, author string, body string, tags_json string, posted_at string, metadata_json string, entry_id string")
    stars = spark.createDataFrame([("https://b.hatena.ne.jp/user-24/20260125#bookmark-9", 10)], "url string, count int")
    old = spark.createDataFrame([("hatena", "r2", "gone", "b", "[]", 1, "", "{}", None), ("hatena", "r1", "other", "b", "[]", 1, "", "{}", None)], "provider string, resource_id string, author string, body string, tags_json string, star_count int, posted_at string, metadata_json string, removed_at timestamp")
    got = {(r["resource_id"], r["author"]): (r["action"], r["star_count"]) for r in comments.refresh(targets, counts, state, talk, stars, old, "hatena").collect()}
    assert got.pop(("r2", "gone"))[0] == "delete" and got.pop(("r1", "other"))[0] == "keep"
    assert got == {("r2", "user-24"): ("insert", 10), **{("r2", f"user-{i:02}"): ("insert", 0) for i in range(19)}}
    after = comments.put_state(state, state.where("resource_id = 'r2'").withColumn("bookmark_count", F.lit(-1)))
    assert sorted((r["resource_id"], r["bookmark_count"]) for r in after.collect()) == [("r1", 3), ("r2", 0), ("r3", 1)]
    looked = spark.createDataFrame([("hatena", "r1", None, None), ("hatena", "r2", None, "2026-01-01"), ("hatena", "r3", "2026-01-01", None)], "provider string, resource_id string, removed_at string, star_checked_at string")
    assert sorted(r["resource_id"] for r in comments.stars_due(looked, state, F.lit("2025-12-31")).collect()) == ["r1"]


def test_items_come_back_and_keep_payloads(spark):
    state = spark.createDataFrame([("p", "a", "1", "res", "m", "h", "gone"), ("p", "a", "2", "res", "m", None, None), ("p", "a", "3", "res", "m", None, "gone")], "provider string, account string, native_id string, resource_id string, metadata_hash string, payload_hash string, removed_at string")
    batch = spark.createDataFrame([("p", "a", "1", "https://A.test/", "m", None), ("p", "a", "2", "https://b.test/", "m", "h2"), ("p", "a", "4", "", "m", None)], "provider string, account string, native_id string, url string, metadata_hash string, payload_hash string")
    known = spark.createDataFrame([("known", "https://a.test/")], "resource_id string, canonical_url string")
    got = {r["native_id"]: r for r in items.upsert_items(state, batch, known).collect()}
    assert {k: (r["action"], r["restored"], r["removed_at"], r["payload_hash"]) for k, r in got.items()} == {"1": ("unchanged", True, None, "h"), "2": ("update", False, None, "h2"), "3": ("keep", False, "gone", None), "4": ("insert", False, None, None)}
    assert got["1"]["resource_id"] == "known" and got["2"]["resource_id"].startswith("res-") and got["4"]["resource_id"] not in ("known", got["2"]["resource_id"])


def test_cache_and_promotion(spark):
    key = ["rev", "op", "be", "m", "p", "s"]
    requests = spark.createDataFrame([(*key, "f2", "f1"), ("rev2", *key[1:], "g2", "g1"), ("rev3", *key[1:], "h2", "h1")], ", ".join(f"{c} string" for c in [*runs.CACHE_KEY, "fingerprint", "legacy_fingerprint"]))
    done = spark.createDataFrame(
        [(*key, "f2", 2, "completed", 1, "a", "old"), (*key, "f2", 2, "completed", 2, "b", "new"), (*key, "f1", 1, "completed", 3, "c", "legacy"), ("rev2", *key[1:], "g1", 1, "completed", 1, "d", "legacy"), ("rev3", *key[1:], "h2", 2, "failed", 1, "e", None)],
        ", ".join(f"{c} string" for c in runs.CACHE_KEY) + ", fingerprint string, fingerprint_version int, status string, finished_at int, run_id string, result string",
    )
    found = runs.reusable(requests, done)
    assert sorted((r["resource_revision_id"], r["reused"], r["result"]) for r in found.collect()) == [("rev", "current", "new"), ("rev2", "legacy", "legacy"), ("rev3", None, None)]
    after = runs.promoted(done, found)
    assert sorted((r["run_id"], r["fingerprint"], r["fingerprint_version"]) for r in after.collect())[3] == ("d", "g2", 2)
    assert {r["reused"] for r in runs.reusable(requests, after).collect()} == {"current", None}


def test_limits_chunks_and_schedules(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(10)], "i int, fresh boolean")
    assert [sorted(r["i"] for r in runs.up_to_new(rows, ["i"], F.col("fresh"), n).collect()) for n in (0, 1, 2, 9)] == [[], [0], [0, 1, 2, 3], list(range(10))]
    keyed = spark.createDataFrame([(i, k) for i, k in enumerate(["a", "a", "b", "", None, "a", "c", "d"])], "i int, k string")
    got = runs.chunks(keyed, "k", [F.col("i")], 3).collect()
    by = {}
    for r in got:
        by.setdefault((r["wave"], r["part"]), []).append((r["i"], r["k"]))
    assert len(got) == 8 and all(len(v) <= 3 and len({k for _, k in v if k}) == sum(bool(k) for _, k in v) for v in by.values())
    targets = spark.createDataFrame([("a", None), ("b", 1), ("c", None), ("d", None)], "provider string, hours int")
    past = spark.createDataFrame([("a", "2026-01-01 00:00:00", "completed"), ("b", "2026-01-07 22:00:00", "completed"), ("c", "2026-01-07 22:00:00", "completed"), ("d", "2026-01-07 22:00:00", "failed")], "provider string, finished_at string, status string")
    due = runs.due_by_hours(targets, past, "provider", F.lit("2026-01-08 00:00:00").cast("timestamp"))
    assert sorted(r["provider"] for r in due.collect()) == ["a", "b", "d"]
    started = spark.createDataFrame([("1", ["x"], 1, "completed"), ("2", ["x", "y"], 2, "failed"), ("3", ["y"], 3, "completed")], "run_id string, providers array<string>, started_at int, status string")
    assert runs.latest_run(started).first()["run_id"] == "3" and runs.latest_run(started, "x").first()["run_id"] == "2" and runs.latest_run(started, "x", completed=True).first()["run_id"] == "1"
    one = runs.one_item_a_resource(spark.createDataFrame([("r",)], "resource_id string"), spark.createDataFrame([("r", "b", "B"), ("r", "a", "A")], "resource_id string, source_id string, metadata string"))
    assert one.first()["metadata"] == "A"


def test_collections(spark):
    from lodestack.sources import paged

    roots = spark.createDataFrame([(1, "B"), (2, "A")], "id long, title string")
    children = spark.createDataFrame([(3, 1, "C"), (3, 1, "C"), (1, 9, "B")], "id long, parent_id long, title string")
    assert [tuple(r) for r in paged.collections(roots, children).collect()] == [(2, 0, "A"), (1, 0, "B"), (3, 1, "C")]
    ids = spark.createDataFrame([('{"collection":{"$id":7}}',), ("{}",), (None,), ("x",)], "b string").select(paged.collection_id(F.col("b")))
    assert [r[0] for r in ids.collect()] == [7, 0, 0, 0]


def test_source_notes(spark):
    from lodestack.operators import source_notes

    r = spark.createDataFrame([("id-123456789", "Old", "https://a.test/", "m", ("A: title", " says ", ["p1", " "], ["x", "y"], "article")), ("b", None, None, "m", (None, None, None, None, None))], "i string, t string, l string, m string, s struct<note_title: string, summary: string, key_points: array<string>, tags: array<string>, content_type: string>")
    a, b = (x[0] for x in r.select(source_notes.source_note(F.col("i"), F.col("t"), F.col("l"), F.col("m"), F.col("s"))).collect())
    assert a.startswith("---\n") and '\ntitle: "A: title"\n' in a and "managed: true" in a
    assert a.split("---\n", 2)[2] == "\n# A: title\n\n## Summary\n\nsays\n\n## Key Points\n\n- p1\n\n## Tags\n\n#x #y\n\n## Source\n\n- https://a.test/\n- Content type: article\n"
    assert "# Untitled" in b and "## Key Points" not in b and "## Tags" not in b
    notes = spark.createDataFrame([("r1", "1", "same", 1), ("r2", "1", "old", 1), ("r3", "1", "kept", 1)], "resource_id string, run_id string, markdown string, created_at int")
    batch = spark.createDataFrame([("r1", "2", "same", 2), ("r2", "2", "new", 2), ("r4", "2", "first", 2)], "resource_id string, run_id string, markdown string, created_at int")
    got = {x["resource_id"]: (x["action"], x["markdown"], x["created_at"]) for x in source_notes.put_notes(notes, batch).collect()}
    assert got == {"r1": ("unchanged", "same", 1), "r2": ("update", "new", 2), "r3": ("keep", "kept", 1), "r4": ("insert", "first", 2)}
    titles = spark.createDataFrame([("r1", "A/B"), ("r2", None)], "resource_id string, title string")
    assert sorted(x["path"] for x in source_notes.note_files(notes, titles).collect()) == ["A B - r1.md", "Untitled - r2.md", "Untitled - r3.md"]
    outcomes = spark.createDataFrame([("a", "r", True), ("b", "r", False), ("c", None, True)], "source_id string, resource_id string, fetched_body boolean")
    own = spark.createDataFrame([("a", "r", "p"), ("b", "r", "p"), ("z", "r", "other")], "source_id string, resource_id string, provider string")
    assert sorted(map(tuple, source_notes.audited_items(outcomes, own, ["p"]).collect())) == [("a", "a"), ("a", "b"), ("b", "b"), ("c", "c")]
