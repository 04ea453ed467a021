"""Feeds, exports, notes, ledgers and streams."""

import pytest
from pyspark.sql import functions as F

from lodestack.operators import latest, tables
from lodestack.sources import bookmarks, feeds, notes
from lodestack.streaming import incremental

RSS = "<rss version='2.0'><channel><item><title>T</title><link>https://a.test/1</link><description>&lt;b&gt;Summary&lt;/b&gt;</description><category>news</category></item></channel></rss>"
ATOM = "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>i</id><title>T</title><link rel='alternate' type='application/json' href='/j'/><link rel='alternate' type='text/html' href='/h'/><summary>s</summary><category term='tech'/></entry></feed>"
RDF = (
    "<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' xmlns='http://purl.org/rss/1.0/' xmlns:dc='http://purl.org/dc/elements/1.1/' xmlns:c='http://purl.org/rss/1.0/modules/content/'>"
    "<item rdf:about='https://a.test/x'><title>T</title><link>/rel</link><dc:date>2026-01-01T00:00:00Z</dc:date><dc:subject>news</dc:subject><dc:subject>AI</dc:subject><c:encoded>&lt;p&gt;Full body&lt;/p&gt;</c:encoded></item></rdf:RDF>"
)


def test_feeds(spark):
    df = spark.createDataFrame([("https://a.test/feed", RSS), ("https://b.test/feed", ATOM), ("https://c.test/f", RDF), ("https://d.test", "no xml"), ("https://e.test", None), ("https://f.test", "")], "feed_url string, body string")
    got = {r["feed_url"][8]: r for r in feeds.entries(df).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["url"], got["a"]["excerpt"], got["a"]["tags"]) == ("https://a.test/1", "Summary", ["news"])
    assert (got["b"]["url"], got["b"]["native_id"], got["b"]["tags"]) == ("https://b.test/h", "i", ["tech"])
    assert (got["c"]["url"], got["c"]["content"], got["c"]["tags"], got["c"]["published"]) == ("https://c.test/rel", "Full body", ["news", "AI"], "2026-01-01T00:00:00Z")


def test_exports(spark):
    page = '<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><p><DT><A HREF="https://a.test/" ADD_DATE="5" TAGS="x,y" PRIVATE="1">A</A><DD>note<DT><A HREF="https://b.test/">B</A><DT><A HREF="https://b.test/">B2</A></DL>'
    got = {r["url"]: r for r in bookmarks.exported_items(spark.createDataFrame([("f", page), ("g", ATOM), ("h", None)], "file string, body string")).collect()}
    assert (got["https://a.test/"]["tags"], got["https://a.test/"]["comment"], got["https://a.test/"]["private"]) == (["x", "y"], "note", True)
    assert got["https://b.test/"]["title"] == "B2" and len(got) == 3


def test_search_union(spark):
    row = lambda u, c, p: f'{{"entry":{{"title":"t","url":"{u}","snippet":"s"}},"timestamp":0,"comment":"{c}","is_private":{p}}}'
    bodies = [("q", 0, f'{{"bookmarks":[{row("https://a.test", "[x]first", 1)},{{"timestamp":1}}],"meta":{{"status":200,"total":"2"}}}}'), ("r", 1, f'{{"bookmarks":[{row("https://a.test", "[y]second", chr(34) + "0" + chr(34))}],"meta":{{"status":200,"total":1}}}}')]
    got = bookmarks.search_items(spark.createDataFrame(bodies, "query string, seq int, body string")).collect()
    assert [(r["first_seq"], r["first_pos"]) for r in got] == [(0, 0)]
    bad = spark.createDataFrame([("q", 0, '{"meta":{"status":401}}'), ("q", 1, '{"bookmarks":{},"meta":{"total":1}}'), ("q", 2, '{"bookmarks":[],"meta":{"total":"x"}}'), ("q", 3, None), ("q", 4, '{"bookmarks":[],"meta":{"status":200,"total":0}}')], "query string, seq int, body string")
    assert [r[0] for r in bad.orderBy("seq").select(bookmarks.search_problem(F.col("body"))).collect()] == ["refused with status 401", "no valid answer", "no valid answer", "no valid answer", None]
    assert bookmarks.search_items(bad, strict=False).count() == 0
    with pytest.raises(Exception, match="bookmark search"):
        bookmarks.search_items(bad).count()
    assert [(r["url"], r["tags"], r["comment"], r["private"], r["created"]) for r in got] == [("https://a.test", ["y"], "second", False, "1970-01-01T00:00:00+00:00")]


def test_notes(spark, tmp_path):
    for name, item in (("b", "1"), ("a", "1"), ("c", "2")):
        (tmp_path / f"{name}.md").write_text(f'---\nsource_item_id: "{item}"\nkind: raw\ntags: [x, "y z"]\nmore:\n  - p\n  - q\n---\nbody\n')
    df = notes.read_notes(spark, str(tmp_path))
    assert df.select(notes.front_list("text", "tags"), notes.front_list("text", "more")).distinct().collect() == [(["x", "y z"], ["p", "q"])]
    assert sorted((r["item_id"], r["kind"], r["path"].rsplit("/", 1)[1]) for r in notes.managed_paths(df).collect()) == [("1", "raw", "a.md"), ("2", "raw", "c.md")]


def test_preferred_notes_and_what_they_send(spark):
    note = lambda i, model, at, body: f'---\nraindrop_id: {i}\nsummary_model: {model}\nsummary_generated_at: "{at}"\ntags: [base, Some Tag, x]\n---\n# T\n\n## Summary\n\n{body}\n\n## Other\nrest'
    df = spark.createDataFrame([("r/a.md", note(1, "m", "2026-01-01T00:00:00Z", "old"), 5), ("r/b.md", note(1, "m", "2026-02-01T00:00:00Z", "new"), 1), ("r/c.md", note(1, "", "", "none"), 9), ("r/d.md", note("x", "m", "", "no id"), 1), ("r/e.md", "no front matter", 1)], "path string, text string, modified long")
    assert [tuple(r) for r in notes.summaries_to_send(df).collect()] == [(1, "new")]
    assert sorted((r[0], r[1]) for r in df.select("path", notes.has_summary("text")).collect()) == [("r/a.md", True), ("r/b.md", True), ("r/c.md", False), ("r/d.md", True), ("r/e.md", True)]
    have = spark.createDataFrame([(1, ["X"])], "key long, tags array<string>")
    assert [tuple(r) for r in notes.tags_to_send(df, have, ["Base"]).collect()] == [(1, ["some-tag"])]


def test_feed_items_of_configured_feeds(spark):
    xml = "<rss><channel><title>Own title</title><item><title>A</title><link>/a</link><guid isPermaLink='false'>g</guid><category>AI</category><pubDate>Thu, 19 Mar 2026 05:25:42 GMT</pubDate></item></channel></rss>"
    rows = [("https://f.test/rss.xml", xml, "", None, ["mine", "ai"], "", {"ai": "tech/ai"}), ("https://g.test/", xml, "Named", "Folder", None, "fixed", None), ("https://bad.test/", "<rss", "", "", None, "", None)]
    df = spark.createDataFrame(rows, "feed_url string, body string, name string, folder string, tags array<string>, route string, routes map<string,string>")
    got = {r["provider_metadata"]["feed_url"]: r for r in feeds.feed_items(df).collect()}
    f, g = got["https://f.test/rss.xml"], got["https://g.test/"]
    assert len(got) == 2 and f["tags"] == ["mine", "ai"] and f["url"] == "https://f.test/a" and f["provider_metadata"]["feed_route"] == "tech/ai" and f["provider_metadata"]["feed_folder"] == "Own title"
    assert g["provider_metadata"]["feed_title"] == "Named" and g["provider_metadata"]["feed_folder"] == "Folder" and g["provider_metadata"]["feed_route"] == "fixed" and f["source_id"] != g["source_id"]
    assert sorted((r["feed_url"], r["readable"]) for r in feeds.read_feeds(df).collect()) == [("https://bad.test/", False), ("https://f.test/rss.xml", True), ("https://g.test/", True)]


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "l")
    notes.append_ledger(spark.createDataFrame([(1, 2)], "a int, b int"), path)
    notes.append_ledger(spark.createDataFrame([(3, 4)], "a int, b int"), path)
    (tmp_path / "l" / "bad.json").write_text("{broken\n")
    assert sorted(r["a"] for r in notes.read_ledger(spark, path, "a int, b int").collect()) == [1, 3]


def test_merge_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    seen = []
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, n int, v string").coalesce(1).write.parquet(src)
    run = lambda: incremental.merge_stream(spark.readStream.schema("k string, n int, v string").parquet(src), out, ["k"], "n", ["v"], ck, lambda i, c: seen.append(c)).awaitTermination()
    run()
    spark.createDataFrame([("a", 3, "y"), ("c", 1, "w")], "k string, n int, v string").write.mode("append").parquet(src)
    run()
    assert sorted((r["k"], r["v"]) for r in tables.read_table(spark, out).collect()) == [("a", "y"), ("b", "z"), ("c", "w")]
    assert seen[0] == {"insert": 2} and seen[-1].get("insert") == 1 and "update" not in seen[-1]
    assert incremental.known_skip(spark.createDataFrame([("a",), ("q",)], "k string"), tables.read_table(spark, out), "k").collect()[0]["k"] == "q"


def test_streak_stream_equals_batch(spark, tmp_path):
    import random

    r = random.Random(2)
    data = [(k, i, x == "f", x == "s") for k in "ab" for i, x in enumerate(r.choice("fsb") for _ in range(12))]
    schema = "k string, seq int, failed boolean, reset boolean"
    for part in (data[:10] + data[12:20], data[10:12] + data[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.session(spark)
    q = incremental.streak_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "k")
    q.writeStream.format("memory").queryName("streaks").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    want = {x["k"]: x["streak"] for x in latest.latest_by_key(latest.failure_streaks(spark.createDataFrame(data, schema), "k", [F.col("seq")], F.col("failed"), F.col("reset")), ["k"], [F.col("seq")]).collect()}
    got: dict = {}
    for x in spark.table("streaks").collect():
        got.setdefault(x["k"], []).append(x["streak"])
    assert all(want[k] in v for k, v in got.items()) and set(got) == set(want)


def test_paged_source(spark, tmp_path):
    import json as js

    from lodestack.sources import paged

    pages = {"q-0": 3, "q-1": 3, "q-2": 1, "q-3": 3, "r-0": 0}
    for name, n in pages.items():
        (tmp_path / f"{name}.json").write_text(js.dumps({"items": [{"id": f"{name}-{i}"} for i in range(n)]}))
    got = paged.read_pages(spark, str(tmp_path), page_size=3).collect()
    assert [(r["query"], r["page"], r["pos"]) for r in sorted(got)] == [("q", 0, 0), ("q", 0, 1), ("q", 0, 2), ("q", 1, 0), ("q", 1, 1), ("q", 1, 2), ("q", 2, 0)]
    assert js.loads(got[0]["body"])["id"].startswith("q-")


def test_providers(spark):
    from lodestack.sources import providers

    a = providers.as_item(spark.createDataFrame([("1", "A")], "i string, t string"), source=F.lit("x"), source_id=F.col("i"), title=F.col("t"))
    b = providers.as_item(spark.createDataFrame([("1", "B"), ("2", None)], "i string, t string"), source=F.lit("y"), source_id=F.col("i"), title=F.col("t"))
    assert sorted((r["source_id"], r["title"], r["source"], r["tags"]) for r in providers.union_sources([a, b]).collect()) == [("1", "A", "x", []), ("2", "", "y", [])]
    assert {r["title"] for r in providers.union_sources([a, b], first_wins=False).collect()} == {"B", ""}
    back = providers.from_metadata(providers.metadata(a), "none").first()
    assert (back["source"], back["title"], back["url"]) == ("x", "A", "")
    talk = spark.createDataFrame([("r", '{"count":2,"eid":"e","bookmarks":[{"user":"u","tags":["t"],"timestamp":"s","comment":"hi"},{"user":"v","comment":""}]}'), ("s", "{broken")], "resource_id string, body string")
    assert [(r["user"], r["comment"], r["entry_id"]) for r in providers.discussion(talk).collect()] == [("u", "hi", "e")]
