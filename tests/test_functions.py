"""Scalar functions against fixed examples and the standard library."""

from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from lodestack.functions import html, json, quality, records, text, times, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://Example.COM:443/path?q=1#section", "https://example.com/path?q=1"),
        ("http://a.test:80", "http://a.test/"),
        ("http://a.test:8080/x", "http://a.test:8080/x"),
        ("https://user:pw@A.test/p/?utm=1", "https://a.test/p/?utm=1"),
        ("  https://a.test/#x ", "https://a.test/"),
        ("https://a.test/?", "https://a.test/"),
        ("no url", "no url"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, url, urls.canonical_url) == want
    if want and "://" in want:
        assert one(spark, url, urls.url_host) == urlsplit(want).hostname


def test_safe_to_fetch(spark):
    rows = [
        ("https://a.test/", True), ("ftp://a.test/", False), ("http://127.0.0.1/", False), ("http://10.1.2.3/", False), ("http://172.20.0.1/", False), ("http://localhost/", False), (None, False), ("http://[fd00::1]/", False), ("http://[::1]:80/x", False),
        ("http://[::ffff:10.0.0.1]/", False), ("http://2130706433/", False), ("http://0x7f.1/", False), ("http://127.1/", False), ("http://198.18.0.1/", False), ("http://224.0.0.1/", False), ("http://240.0.0.1/", False), ("http://[fe80::1%25eth0]/", False),
        ("http://8.8.8.8/", True), ("http://[2606:4700::1111]/", True), ("http://dead.beef.test/", True), ("http://printer.local/", False), ("http:///x", False), ("", False),
    ]
    got = spark.createDataFrame(rows, "u string, w boolean").select("w", urls.safe_to_fetch("u").alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)
    assert one(spark, "http://10.1.2.3/", lambda c: urls.safe_to_fetch(c, ("10.1.2.3",))) is True
    assert one(spark, "HTTP://[FD00::1]:8080/a", urls.url_host) == "fd00::1" and one(spark, "HTTP://[FD00::1]:8080/a", urls.canonical_url) == "http://fd00::1:8080/a"


def test_star_and_content_urls(spark):
    assert one(spark, "2026-03-04T05:06:07", lambda c: urls.star_url(F.lit("u"), c, F.lit("9"))) == "https://b.hatena.ne.jp/u/20260304#bookmark-9"
    assert one(spark, "2026", lambda c: urls.star_url(F.lit("u"), c, F.lit("9"))) == "" and one(spark, None, lambda c: urls.star_url(c, c, c)) == ""
    assert one(spark, "https://megalodon.jp/2020/x?y", urls.content_url) == "https://megalodon.jp/ref/2020/x?y"
    for same in ("https://megalodon.jp/ref/2020", "https://a.test/2020", None):
        assert one(spark, same, urls.content_url) == same


def test_text_of_runs(spark):
    assert one(spark, "abcdefghij", lambda c: text.untrusted(c, "<", ">", 8, "!")) == "<abcde!>" and one(spark, "ab", lambda c: text.untrusted(c, "<", ">", 8, "!")) == "<ab>"
    routes = F.create_map(F.lit("News"), F.lit("n"), F.lit("AI"), F.lit("a"))
    assert one(spark, "x", lambda c: text.first_route(F.array(c, F.lit("ai"), F.lit("news")), routes)) == "a" and one(spark, "x", lambda c: text.first_route(F.array(c), routes)) == ""
    e = F.lit("")
    got = one(spark, "\n  first one \nsecond", lambda c: text.fallback_summary(e, F.lit("https://a.test"), e, e, c, F.array(*[F.lit(str(i)) for i in range(9)]), e))
    assert got.note_title == "https://a.test" and got.summary == "first one" and len(got.tags) == 8 and got.content_type == "link"
    assert one(spark, None, lambda c: text.fallback_summary(c, c, c, c, c, F.lit(None).cast("array<string>"), c)).summary == "Summary unavailable."
    ids = [one(spark, t, lambda c: text.time_ordered_id(c.cast("timestamp"), F.lit("k"))) for t in ("2026-01-01 00:00:00", "2026-01-01 00:00:01", "2026-01-01 00:00:01")]
    assert ids[0] < ids[1] == ids[2] and len(ids[0]) == 36 and ids[0][14] == "7"


def test_summary_problems(spark):
    ask = lambda s: one(spark, s, records.summary_problems)
    good = '{"note_title":"t","summary":"s","key_points":["a"],"tags":[],"content_type":"link"}'
    assert ask(good) == [] and ask("[]") == ask(None) == ask("x") == ["no object"]
    assert ask(good[:-1] + ',"more":1}') == ["more is unexpected"] and ask(good.replace('"t"', "5")) == ["note_title is no text"]
    assert ask(good.replace('["a"]', '["a","b","c","d","e"]')) == ["key_points has too many entries"] and ask(good.replace('"s"', '"' + "x" * 301 + '"')) == ["summary is too long"]
    assert ask('{"note_title":"t"}') == ["summary is missing", "key_points is missing", "tags is missing", "content_type is missing"]


@pytest.mark.parametrize(
    "s, want",
    [
        ("2026-03-19T05:25:42+00:00", 1773897942), ("2026-03-19T05:25:42Z", 1773897942), ("Thu, 19 Mar 2026 05:25:42 GMT", 1773897942),
        ("19 Mar 2026 06:25:42 +0100", 1773897942), ("2026-03-19T05:25:42", 1773897942), ("", None), ("soon", None), (None, None),
    ],
)
def test_parse_instant(spark, s, want):
    assert one(spark, s, times.epoch_seconds) == want


def test_own_month_and_backoff(spark):
    assert one(spark, "2026-01-01T00:30:00+09:00", times.own_year_month) == "2026/01"
    assert one(spark, "Thu, 1 Jan 2026 00:30:00 GMT", times.own_year_month) == "2026/01"
    assert [one(spark, n, times.backoff_minutes, "int") for n in (1, 2, 3, 64, 5000)] == [30, 60, 120, 43200, 43200]


def test_tags(spark):
    assert [one(spark, t, text.normalize_tag) for t in ("#Machine Learning", "  ##C++ ", "クエリ 最適化", "-/a/-", "", None)] == ["machine-learning", "c", "クエリ-最適化", "a", "", None]
    df = spark.createDataFrame([(["News", "news", " AI ", "", None, "ai"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(text.unique_tags("t")).collect()] == [["News", "AI"], [], []]
    assert df.select(text.merge_tags("t", F.array(F.lit("#AI"), F.lit("x y")))).first()[0] == ["news", "ai", "x-y"]


def test_bracket_comment(spark):
    df = spark.createDataFrame([("[python][あとで読む]秘密のコメント",), ("no tags [x]",), ("",), (None,)], "c string")
    assert [(r[0], r[1]) for r in df.select(text.bracket_tags("c"), text.bracket_rest("c")).collect()] == [(["python", "あとで読む"], "秘密のコメント"), ([], "no tags [x]"), ([], ""), ([], "")]


def test_names_and_paths(spark):
    assert [one(spark, t, text.file_name) for t in ("a/b: c?", "con", "…", "é", None, "CON.txt")] == ["a b c", "con_", "", "é", "", "CON.txt"]
    assert one(spark, "../a\\./b//c/..", text.safe_relative_path) == "a/b/c"
    df = spark.createDataFrame([("t" * 70, "id1")], "t string, i string")
    assert df.select(text.note_name("t", "i")).first()[0] == "t" * 60 + " - id1.md"
    assert df.select(text.note_name(F.lit("…"), "i"), text.note_name(F.lit(None).cast("string"), "i", F.lit("https://a.test/"))).first()[:] == ("Untitled - id1.md", "https a.test - id1.md")
    where = lambda layout, month: df.select(text.feed_folder_path(layout, F.lit("tech/../ai"), F.lit("My feed"), F.lit(month).cast("string"))).first()[0]
    assert (where("flat", "2026/01"), where("feed", "2026/01"), where("feed/year", "2026/01"), where("route/feed/year/month", "2026/01"), where("feed/year/month", None)) == ("", "My feed", "My feed/2026", "tech/ai/My feed/2026/01", "My feed/_undated")


def test_front_matter(spark):
    df = spark.createDataFrame([('a "b"', None, ["x", "y"], [], True, 3)], "t string, e string, l array<string>, m array<string>, b boolean, n int")
    got = df.select(text.front_matter({"title": F.col("t"), "e": F.col("e")}, {"l": F.col("l"), "m": F.col("m")}, {"b": F.col("b"), "n": F.col("n")})).first()[0]
    assert got == '---\ntitle: "a \\"b\\""\nl:\n  - "x"\n  - "y"\nm: []\nb: true\nn: 3\n---'


def test_blocks_and_blank(spark):
    assert one(spark, "a  b\r\n\r\n\r\n\r\nc \n", text.normalize_blocks) == "a b\n\nc"
    assert [one(spark, v, text.is_blank, "string") for v in ("", " 　\n", None, "x")] == [True, True, True, False]
    assert one(spark, "a\nAdvertisement\nb", text.without_ads) == "a\n\nb"
    assert one(spark, "<p>a &amp; <b>b</b></p><script>x</script>", text.plain_of_html) == "a & b"


def test_managed_block(spark):
    put = lambda c: text.put_block(c, F.lit("new"), "<!--a-->", "<!--b-->")
    assert one(spark, "x", put) == "x\n\n<!--a-->\nnew\n<!--b-->"
    assert one(spark, "x\n<!--a-->\nold\n<!--b-->\ny", put) == "x\n<!--a-->\nnew\n<!--b-->\ny"
    assert one(spark, None, put) == "<!--a-->\nnew\n<!--b-->"


def test_quality(spark):
    long = "word " * 60
    assert one(spark, long, quality.high_confidence) and not one(spark, "short", quality.high_confidence)
    assert not one(spark, long + "�" * 3, quality.high_confidence)
    df = spark.createDataFrame([(None, None, None, True), ("x" * 79, "", "", True), ("x" * 150, "<div class='a' id='root'>", "", True), ("x" * 150, "", "", False), ("Title " + "x" * 40, "", "Title", False)], "t string, h string, i string, w boolean")
    assert all(r["w"] == r["g"] for r in df.select("w", quality.needs_rendering("t", "h", "i").alias("g")).collect())
    ab = spark.createDataFrame([("x" * 250, "y" * 300), ("x" * 300, "y" * 250), (None, "y"), ("same", "same")], "a string, b string")
    assert [r[0][:1] for r in ab.select(quality.better("a", "b")).collect()] == ["y", "x", "y", "s"]


def test_json(spark):
    assert one(spark, '{"a": 1, "b": "x", "c": [1.5]}', lambda c: json.without_keys(c, "b")) == '{"a":1,"c":[1.5]}'
    assert one(spark, '{"a": 1}', lambda c: json.with_true(c, "b")) == '{"a":1,"b":true}'
    assert one(spark, '{"Content-Type": "x"}', lambda c: json.header(c, "content-TYPE")) == "x"
    assert one(spark, "{}", lambda c: json.header(c, "etag")) is None
    assert [one(spark, v, json.tag_list) for v in ('["a","b"]', "{}", "", None, "[")] == [["a", "b"], [], [], [], []]
    df = spark.createDataFrame([("x", None), ("x", "")], "t string, u string").select(json.content_hash(t=F.col("t"), u=F.col("u")).alias("h"))
    assert len({r["h"] for r in df.collect()}) == 2


def test_page_regions():
    page = "<html><title> A  b </title><body><nav>menu</nav><main>wrong <img src='/m.png'></main><article><p>right text</p><div class='ad'>ad</div><img src='x.png' alt='X'><img src='/dot.gif' width=1 height=1><img class='ad-slot' src='/s.png'></article></body></html>"
    got = html.parse_page(page, "https://a.test/d/")
    assert (got["title"], got["text"]) == ("A b", "right text")
    assert html.parse_page("<div class='post-content'>a<b>b</b>c</div><p>other</p>")["text"] == "a b c"
    assert got["images"] == [{"url": "https://a.test/d/x.png", "alt": "X"}]
    assert html.parse_page("<p>only</p>")["text"] == "only"
    assert html.parse_page(None)["text"] == "" and html.parse_page("")["title"] == ""


def test_decode_page():
    assert html.decode_page("日本".encode("shift_jis"), "Shift_JIS") == "日本"
    assert html.decode_page(b"<meta charset=euc-jp>" + "日本".encode("euc_jp"), None).endswith("日本")
    assert html.decode_page("é".encode(), "") == "é" and html.decode_page(b"\xe9", "nope") == "é" and html.decode_page(None, None) is None
