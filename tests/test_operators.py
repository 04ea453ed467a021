"""Relational operators on small tables, with ties, nulls, copies and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestack.functions import urls
from lodestack.operators import diversity, identity, latest, merge, render, sampling, search, snapshot, tables
from lodestack.plans import refresh


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_latest_by_key_with_ties_nulls_and_layout(spark):
    data = [(k, t, i) for k in ("a", "b", None) for t in (None, 1, 2, 2) for i in range(3)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k string, t int, i int").repartition(seed + 1)
        got = rows(latest.latest_by_key(df, ["k"], [F.col("t"), F.col("i")]).select("k", "t", "i"))
        want = want or got
        assert got == want == [("a", 2, 2), ("b", 2, 2), (None, 2, 2)]
    assert latest.latest_by_key(df.limit(0), ["k"], [F.col("i")]).count() == 0


def test_top_comments(spark):
    data = [("r", f"user-{i:02}", 1, 5) for i in range(24)] + [("r", "user-24", 10, 9), ("r", "user-25", None, 1)]
    df = spark.createDataFrame(data, "r string, u string, stars int, t int")
    got = latest.top_n(df, ["r"], [F.coalesce("stars", F.lit(0)).desc(), F.col("t").asc_nulls_last(), F.col("u")], 20)
    assert [x["u"] for x in got.orderBy("rank").collect()] == ["user-24"] + [f"user-{i:02}" for i in range(19)]


def test_streaks_equal_a_fold(spark):
    r = random.Random(3)
    data = [(k, i, kind == "f", kind == "s") for k in "abc" for i, kind in enumerate(r.choice("ffsb") for _ in range(40))]
    got = {(x["k"], x["i"]): x["streak"] for x in latest.failure_streaks(spark.createDataFrame(data, "k string, i int, f boolean, s boolean"), "k", [F.col("i")], F.col("f"), F.col("s")).collect()}
    n: dict = {}
    for k, i, f, s in data:
        n[k] = n.get(k, 0) + 1 if f else 0 if s else n.get(k, 0)
        assert got[k, i] == n[k]


def test_streaks_cut_by_periods(spark):
    r = random.Random(8)
    data = [(k, i, i // 7, x == "f", x == "s") for k in ("a", "b", None) for i, x in enumerate(r.choice("fffsbb") for _ in range(60))]
    df = spark.createDataFrame(data, "k string, i int, t int, f boolean, s boolean")
    one = latest.failure_streaks(df, "k", [F.col("i")], F.col("f"), F.col("s"))
    cut = latest.failure_streaks(df, "k", [F.col("i")], F.col("f"), F.col("s"), F.col("t"))
    assert rows(one) == rows(cut) and one.columns == cut.columns


def test_row_numbers_of_hot_keys(spark):
    from lodestack.operators import ranks

    df = spark.createDataFrame([("hot" if i % 3 else ("x", None)[i % 2], (i * 37) % 101) for i in range(101)], "k string, i int").repartition(7)
    plain = ranks.row_numbers(df, ["k"], [F.col("i")], "n")
    assert rows(plain) == rows(ranks.row_numbers(df, ["k"], [F.col("i")], "n", hot_rows=5))
    assert ranks.row_numbers(df.limit(0), ["k"], [F.col("i")], "n").count() == 0


def test_stale_pages_waves_and_budget(spark):
    pages = spark.createDataFrame([("q", i, n) for i, n in enumerate([True, False, True, False, False, False])] + [("p", 0, True)], "q string, p int, n boolean")
    assert rows(latest.first_stale_page(pages, "q", "p", F.col("n"), 2)) == [("q", 4)]
    items = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "u string, i int")
    assert rows(latest.waves(items, "u", [F.col("i")]).select("i", "wave")) == [(1, 1), (2, 2), (3, 1)]
    a, b = spark.range(3), spark.range(10, 20)
    got = latest.shared_budget(a, b, [F.col("id")], [F.col("id")], 5)
    assert rows(got.select("id", "turn")) == sorted([(0, 0), (1, 0), (2, 0), (10, 1), (11, 1)], key=str)


def test_upsert_actions_and_idempotence(spark):
    t = spark.createDataFrame([("a", "1", 1), ("b", None, 2), ("c", "3", 3)], "k string, v string, w int")
    b = spark.createDataFrame([("b", None, 9), ("c", "x", 3), ("d", "4", None)], "k string, v string, w int")
    m = merge.upsert(t, b, ["k"], ["v"])
    assert rows(m) == [("a", "1", 1, "keep"), ("b", None, 2, "unchanged"), ("c", "x", 3, "update"), ("d", "4", None, "insert")]
    again = merge.upsert(m.drop("action"), b, ["k"], ["v"])
    assert {r["action"] for r in again.collect()} == {"keep", "unchanged"}
    assert {r["k"]: r["action"] for r in merge.upsert(t, b, ["k"], ["v"], delete_missing=True).collect()}["a"] == "delete"
    assert merge.upsert(t.limit(0), b, ["k"], ["v"]).where("action = 'insert'").count() == 3
    assert merge.upsert(t, b.limit(0), ["k"], ["v"]).where("action = 'keep'").count() == 3


def test_carry_over_blobs_and_orphans(spark):
    t = spark.createDataFrame([("a", 5)], "k string, stars int")
    b = spark.createDataFrame([("a", None), ("b", None), ("c", 1)], "k string, stars int")
    assert rows(merge.carry_over(t, b, ["k"], ["stars"])) == [("a", 5), ("b", None), ("c", 1)]
    store = spark.createDataFrame([("x",)], "c string").select(F.sha2("c", 256).alias("sha256"))
    batch = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "i int, c string")
    assert [r["i"] for r in merge.put_blobs(store, batch, "c", F.col("i")).collect()] == [2]
    blobs = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    refs = spark.createDataFrame([(1, None), (None, 3)], "a int, b int")
    assert rows(merge.orphans(blobs, "p", [(refs, "a"), (refs, "b")])) == [(2,)]


def test_write_table_replaces(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(tables.NoTableError):
        tables.read_table(spark, p)
    for n in (3, 5, 7, 9):
        tables.write_table(spark.range(n), p)
        assert tables.read_table(spark, p).count() == n
    assert len(list((tmp_path / "t").glob("data-*"))) == 2


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    p = str(tmp_path / "t")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v int")
    assert tables.merge_batch(batch(("a", 1), ("b", 2)), p, ["k"], ["v"], "w", 0, 4) == {"insert": 2}
    put = tables._Files.put

    def killed(*args):
        raise KeyboardInterrupt

    for at in ("put", "forget"):  # before the new version is in place, and after it
        monkeypatch.setattr(tables._Files, at, killed)
        with pytest.raises(KeyboardInterrupt):
            tables.merge_batch(batch(("a", 5), ("c", 3)), p, ["k"], ["v"], "w", 1)
        monkeypatch.undo()
        want = [("a", 1), ("b", 2)] if at == "put" else [("a", 5), ("b", 2), ("c", 3)]
        assert sorted(map(tuple, tables.read_table(spark, p).collect())) == want
    assert put is tables._Files.put
    # the batch comes again, and is in the table already
    assert tables.merge_batch(batch(("a", 5), ("c", 3)), p, ["k"], ["v"], "w", 1) is None
    assert tables.merge_batch(batch(("a", 5)), p, ["k"], ["v"], "w", 2) == {"unchanged": 1} or tables.manifest(spark, p)["batches"] == {"w": 2}
    assert sorted(map(tuple, tables.read_table(spark, p).collect())) == [("a", 5), ("b", 2), ("c", 3)]
    # another writer was faster
    before = tables.manifest(spark, p)
    with pytest.raises(tables.ConflictError):
        tables._Files(spark, p).put(before["number"], before)
    # a table that has gone is not an empty one
    import shutil

    shutil.rmtree(p)
    with pytest.raises(tables.NoTableError):
        tables.merge_batch(batch(("d", 1)), p, ["k"], ["v"], "w", 3)
    assert not (tmp_path / "t").exists()


def test_only_touched_buckets_are_written(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    tables.merge_batch(rows, p, ["k"], ["v"], "w", 0, 16)
    before = tables.manifest(spark, p)["folders"]
    tables.merge_batch(rows.where("k = '7'").withColumn("v", F.lit(1)), p, ["k"], ["v"], "w", 1)
    after = tables.manifest(spark, p)["folders"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert tables.read_table(spark, p).agg(F.sum("v"), F.count("*")).first()[:] == (1, 200)


@pytest.mark.parametrize("value, n, want", [("10%", 50, 20), ("10%", 3112, 312), ("5", 50, 5), ("0", 50, 0), ("1000", 3, 3), ("0%", 50, 0)])
def test_sample_size(value, n, want):
    assert sampling.sample_size(value, n) == want


@pytest.mark.parametrize("value", ["abc", "101%", "NaN%", "-1"])
def test_sample_size_errors(value):
    with pytest.raises(ValueError):
        sampling.sample_size(value, 10)


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, 1 if i <= 8 else 2) for i in range(1, 11)], "i int, g int")
    assert [r[0] for r in sampling.stratified(df, "g", [F.col("i")], 5).select("i").orderBy("i").collect()] == [2, 4, 6, 8, 10]
    r = random.Random(1)
    for _ in range(6):
        sizes = {f"s{j}": r.randint(1, 30) for j in range(r.randint(1, 8))}
        n = r.randint(0, 40)
        got = {x["g"]: x["take"] for x in sampling.allocate(spark.createDataFrame(list(sizes.items()), "g string, size long"), "g", n).collect()}
        assert sum(got.values()) == min(n, sum(sizes.values())) and all(0 <= got[g] <= s for g, s in sizes.items())


def test_round_robin_equals_the_loop(spark):
    r = random.Random(5)
    for _ in range(3):
        records = [(i, f"t{r.randint(0, 4)}", r.randint(1, 9)) for i in range(30)]
        n_by = Counter(t for _, t, _ in records)
        covered = {t for t in n_by if r.random() < 0.4}
        sizes = spark.createDataFrame([(t, n, t in covered or None) for t, n in n_by.items()], "topic string, n long, covered boolean")
        df = spark.createDataFrame(records, "i int, topic string, w int")
        got = [x["i"] for x in diversity.round_robin(df, "topic", [F.col("w").desc(), F.col("i")], sizes, 12).collect()]
        largest = sorted(n_by, key=lambda t: (-n_by[t], t in covered, t))
        fresh = [t for t in largest if t not in covered]
        order: list[str] = []
        for i in range(len(largest)):
            order += [t for t in dict.fromkeys(largest[i : i + 1] + fresh[i : i + 1]) if t not in order]
        queues = {t: sorted((x for x in records if x[1] == t), key=lambda x: (-x[2], x[0])) for t in n_by}
        want = []
        while len(want) < 12 and any(queues.values()):
            for t in order:
                if queues[t] and len(want) < 12:
                    want.append(queues[t].pop(0)[0])
        assert got == want


def test_topics(spark):
    df = spark.createDataFrame([(["#News", "AI", "ai"], "x", "https://www.a.test/"), ([], "Big data 日記ノート", None), (None, None, "https://www.a.test/")], "t array<string>, n string, u string")
    assert [r[0] for r in df.select(diversity.topics(F.col("t"), F.col("n"), F.col("u"))).collect()] == [["ai"], ["big", "data", "日記ノート"], ["a.test"]]
    assert spark.range(1).select(urls.default_feed_folder(F.lit("https://a.test/blog/news.xml")), urls.default_feed_folder(F.lit("https://a.test/feed.xml"))).first()[:] == ("a.test - news", "a.test")


def test_trigram_search(spark):
    docs = spark.createDataFrame([(1, "Data lake"), (2, "データベース"), (3, None), (4, "da"), (5, "")], "i int, t string")
    index = search.build_index(docs, "i", ["t"])
    find = lambda term: sorted(r["i"] for r in search.search(index, docs, "i", "t", term).collect())
    assert (find("DATA"), find("データ"), find("da"), find("zzz")) == ([1], [2], [1, 4], [])


def test_resolve_is_stable(spark):
    items = spark.createDataFrame([("a", "https://X.test/"), ("b", "https://x.test:443/#f"), ("c", None), ("d", "")], "k string, u string")
    known = spark.createDataFrame([], "resource_id string, canonical_url string")
    one = identity.resolve(items, known, "k", "u")
    ids = {r["k"]: r["resource_id"] for r in one.collect()}
    assert ids["a"] == ids["b"] and len(set(ids.values())) == 3
    two = identity.resolve(items, one.select("resource_id", "canonical_url").distinct(), "k", "u")
    assert {r["k"]: r["resource_id"] for r in two.collect()} == ids and not any(r["is_new"] for r in two.collect())


def test_render_actions(spark):
    seal = lambda c: render.sealed(F.concat(F.lit("---\na: 1\n---\n"), c))
    w = spark.createDataFrame([("same", "p"), ("new", "p"), ("moved", "q"), ("changed", "p"), ("touched", "p")], "item_id string, path string").withColumn("document", seal(F.concat("item_id", F.when(F.col("item_id") == "changed", "2").otherwise(""))))
    e = spark.createDataFrame([("same",), ("moved",), ("changed",), ("touched",), ("gone",)], "item_id string").withColumn("path", F.lit("p")).withColumn("document", F.concat(seal(F.col("item_id")), F.when(F.col("item_id") == "touched", "!").otherwise("")))
    got = {r["item_id"]: r["action"] for r in render.actions(w, e).collect()}
    assert got == {"same": "skipped", "new": "written", "moved": "moved", "changed": "written", "touched": "conflict", "gone": "removed"}


def test_write_documents(spark, tmp_path):
    put = lambda *r: {x["path"]: x["outcome"] for x in render.write_documents(spark.createDataFrame(r, "path string, document string"), str(tmp_path)).collect()}
    assert put(("a/b.md", "é"), ("../../out.md", "x")) == {"a/b.md": "written", "out.md": "written"}
    assert (tmp_path / "out.md").exists() and put(("a/b.md", "é")) == {"a/b.md": "skipped"}
    assert put(("a/b.md", "other")) == {"a/b.md": "conflict"}  # it carries no seal
    one, two = (spark.createDataFrame([(f"---\nt: {i}\n---\nbody",)], "d string").select(render.sealed(F.col("d"))).first()[0] for i in (1, 2))
    assert put(("c.md", one)) == {"c.md": "written"} and put(("c.md", two)) == {"c.md": "written"}
    (tmp_path / "c.md").write_text(two + "by hand")
    assert put(("c.md", one)) == {"c.md": "conflict"}
    assert (tmp_path / "a/b.md").read_text() == "é"


def test_snapshot_round_trip_and_tamper(spark, tmp_path):
    folder = str(tmp_path / "s")
    tables = {"a": spark.range(5).withColumn("m", F.create_map(F.lit("k"), F.col("id"))), "b": spark.range(0)}
    snapshot.write_snapshot(tables, folder)
    assert snapshot.restore(spark, folder)["a"].count() == 5
    with pytest.raises(FileExistsError):
        snapshot.write_snapshot(tables, folder)
    tables["a"].limit(4).write.mode("overwrite").parquet(f"{folder}/a")
    with pytest.raises(ValueError):
        snapshot.restore(spark, folder)


def test_fingerprint_of_many_rows(spark):
    df = spark.range(20_000)
    h = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 52)).alias("h"))
    want = sum(r["h"] for r in h.collect())
    assert want > 1 << 63  # more than a long holds
    assert tuple(snapshot.fingerprint(df).first()) == (20_000, str(want))
    assert tuple(snapshot.fingerprint(df.repartition(3)).first()) == (20_000, str(want))
    assert tuple(snapshot.fingerprint(df.limit(0)).first()) == (0, "0")


def test_due_table(spark):
    data = [
        ("never", None, "", False, "", None, None, 0, True), ("fresh", "2026-01-30 00:00:00", "", False, "body", 200, None, 0, False), ("old", "2026-01-01 00:00:00", "", False, "body", 200, None, 0, True),
        ("404", "2020-01-01 00:00:00", "x", False, "", 404, None, 1, False), ("dns2", "2026-01-30 00:00:00", "x", False, "", None, "dns", 2, True), ("dns3", "2020-01-01 00:00:00", "x", False, " ", None, "dns", 3, False),
        ("zero", "2026-01-31 00:00:00", "x", False, "", 500, None, 0, True), ("wait", "2026-01-30 23:31:00", "x", False, "", 500, None, 1, False), ("due", "2026-01-30 23:30:00", "x", False, "", 500, None, 1, True),
        ("payload", "2026-01-30 00:00:00", "x", True, "", 500, None, 1, False),
    ]
    df = spark.createDataFrame(data, "k string, fetched_at string, warning string, has_payload boolean, body string, http_status int, failure_kind string, failures int, want boolean")
    got = refresh.due(df, F.lit("2026-01-31 00:00:00").cast("timestamp"), 7, (404, 410), ("dns", "timeout"), 3, 30, 30)
    assert {r["k"]: r["due"] for r in got.collect()} == {x[0]: x[-1] for x in data}


def test_positions(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, i int")
    assert rows(latest.positions(df, ["k"], [F.col("i")])) == [("a", 1, 0), ("a", 3, 1), ("b", 2, 0)]


def test_shared_resources(spark):
    items = spark.createDataFrame([("a", "https://X.test/"), ("b", "https://x.test/"), ("a", "https://X.test/")], "k string, u string")
    assert rows(identity.shared_resources(items, "k", "u")) == [("https://x.test/", 2, 2, "a")]
    assert items.select(urls.content_key("u")).distinct().count() == 1


def test_lookup_defaults_and_stars(spark):
    from lodestack.operators import lookup

    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    vals = spark.createDataFrame([("a", 3), ("a", 5), ("b", None)], "k string, n int")
    assert rows(lookup.with_default(df, vals, "k", "n", 0)) == [("a", 5), ("b", 0), (None, 0)]
    s = spark.createDataFrame([([(None,), (3,), (0,)], [([(2,)],), ([(None,)],)]), (None, None)], "p array<struct<count: int>>, c array<struct<stars: array<struct<count: int>>>>")
    assert [r[0] for r in s.select(lookup.star_total(F.col("p"), F.col("c"))).collect()] == [8, 0]
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "k string, n int")
    state = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    assert [r["k"] for r in lookup.changed_counts(batch, state, "k", "n").orderBy("k").collect()] == ["b", "c", "d"]
    r = spark.createDataFrame([("x", 2.0, 4.0), ("x", 1.0, 0.0), ("x", None, 4.0), ("y", 1.0, -1.0)], "g string, p double, w double")
    assert rows(lookup.ratio(r, ["g"], F.col("p"), F.col("w"))) == [("x", 0.5, 1)]


def test_checks(spark):
    from lodestack.operators import checks

    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None)], "k string, v int")
    assert rows(checks.repeated_keys(df, ["k"])) == [("a", 2), ("b", 2)]
    assert rows(checks.conflicting_rows(df, "k", ["v"])) == [("b", 2)]
    assert checks.dangling(df, "v", spark.createDataFrame([(1,)], "id int"), "id").count() == 1
    assert rows(checks.report({"x": df, "y": df.limit(0)})) == [("x", 5), ("y", 0)]


def test_migrations(spark):
    from lodestack.operators import migrate

    caps = spark.createDataFrame([("r", "1", None, "2026-01-02", "b"), ("r", "2", "p", "2026-01-01", "a")], "resource_id string, n string, http_payload_id string, fetched_at string, fetch_capture_id string")
    com = spark.createDataFrame([("r", i, None, f"c{i:02}") for i in range(25)], "resource_id string, star_count int, posted_at string, comment_revision_id string")
    out = migrate.migrate({"fetch_capture": caps, "comment_revision": com}, 1, 4)
    assert [r["n"] for r in out["fetch_capture"].collect()] == ["2"] and out["fetch_capture"].first()["consecutive_failures"] == 0
    assert out["comment_revision"].count() == 20 and out["comment_revision"].agg(F.min("star_count")).first()[0] == 5
    with pytest.raises(ValueError):
        migrate.migrate({}, 5, 4)
    with pytest.raises(ValueError):
        migrate.migrate({}, 3, 99)


def test_replace_children(spark):
    old = spark.createDataFrame([("a", "x", 0), ("b", "y", 0)], "p string, u string, position int")
    batch = spark.createDataFrame([("a", " z ", 1), ("a", "", 2), ("a", "w", 3), ("a", "z", 4), ("a", None, 5)], "p string, u string, i int")
    assert rows(merge.replace_children(old, batch, "p", "u", [F.col("i")])) == [("a", "w", 1), ("a", "z", 0), ("b", "y", 0)]


def test_rebuild_once_a_generation(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abcd")], "i int, t string")
    path = str(tmp_path / "index")
    assert search.rebuild(docs, "i", ["t"], path, 1) and not search.rebuild(docs, "i", ["t"], path, 1)
    assert search.rebuild(docs, "i", ["t"], path, 2) and search.rebuild(docs, "i", ["t"], path, 2, force=True)
    assert sorted(r["gram"] for r in tables.read_table(spark, path).collect()) == ["abc", "bcd"]
