"""Pairs and groups against brute force."""

import random

from lodestack.llm import near_duplicates as nd


def _texts(seed=1, families=12):
    r = random.Random(seed)
    words = [f"w{i}x{r.randint(0, 99)}" for i in range(400)]
    out = []
    for f in range(families):
        base = [r.choice(words) for _ in range(110)]
        for rate in (0, 0.02, 0.05, 0.08, 0.12, 0.2, 0.4):
            out.append(" ".join(r.choice(words) if r.random() < rate else w for w in base))
    return out


def _grams(title, content):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in f"{title or ''}\n{content}" if c not in " \t\r\n")
    return {t[i : i + 8] for i in range(len(t) - 7)}


def _brute(rows):
    sets = [(r["resource_revision_id"], _grams(r["title"], r["content_markdown"])) for r in rows if r["content_markdown"] and len(r["content_markdown"]) >= 300]
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a != b and len(x & y) >= 0.6 * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def _rows():
    rows = [{"resource_revision_id": f"r{i:03}", "title": "T" if i % 3 else None, "content_markdown": t} for i, t in enumerate(_texts())]
    rows += [{"resource_revision_id": f"s{i}", "title": "T", "content_markdown": rows[1]["content_markdown"]} for i in range(4)]  # copies of one text
    rows += [{"resource_revision_id": "u", "title": "t", "content_markdown": rows[1]["content_markdown"].upper() + "\n"}]
    rows += [{"resource_revision_id": "null", "title": None, "content_markdown": None}, {"resource_revision_id": "empty", "title": "", "content_markdown": ""}, {"resource_revision_id": "short", "title": "T", "content_markdown": "x" * 299}, rows[0]]
    rows += [{"resource_revision_id": "cjk1", "title": "題", "content_markdown": "日本語の文章を検査する。" * 40 + "A"}, {"resource_revision_id": "cjk2", "title": "題", "content_markdown": "日本語の文章を検査する。" * 40 + "B"}]
    return rows


def test_pairs_equal_brute_force(spark, archive):
    rows = _rows()
    got = [tuple(r) for r in nd.p4_found(spark, archive(resource_revision=rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_groups(spark, archive):
    rows = _rows()
    pairs = _brute(rows)
    root = {r["resource_revision_id"]: r["resource_revision_id"] for r in rows if r["content_markdown"] and len(r["content_markdown"]) >= 300}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["resource_revision_id"]: r for r in nd.p4_groups(spark, archive(resource_revision=rows)).collect()}
    assert {k: r["group_id"] for k, r in got.items()} == {k: find(k) for k in root}
    assert got["s0"]["class_id"] == got["r001"]["class_id"] == got["u"]["class_id"] == "r001"


def test_components_of_a_long_chain(spark):
    n = 60
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (100, 100)], "a int, b int")
    got = {r["node"]: r["root"] for r in nd.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100}


def test_empty_tables(spark, archive):
    d = archive()
    assert nd.p4_found(spark, d).count() == 0 and nd.p4_groups(spark, d).count() == 0


def test_long_runs_in_blocks_give_the_same(spark, archive):
    rows = _rows()
    template = " ".join(f"word{i}" for i in range(60))
    rows += [{"resource_revision_id": f"t{i:02}", "title": "T", "content_markdown": template + " " + " ".join(f"own{i}x{j}" for j in range(55))} for i in range(30)]
    d = archive(resource_revision=rows)
    members, pairs = nd.similar_classes(nd.revisions(spark, d), run_classes=2, block=3)
    name = {r["class"]: r["rev_id"] for r in sorted(members.collect(), reverse=True)}
    got = [tuple(sorted((name[r["a"]], name[r["b"]]))) for r in pairs.collect()]
    first = {}
    for r in members.collect():
        first[r["rev_id"]] = name[r["class"]]
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted((first[a], first[b]))) for a, b in _brute(rows) if first[a] != first[b]}


def test_runs_over_several_batches(spark):
    keys = [1] * 3 + [2] * 5 + [3] + [4] * 2_500 + [5] * 2
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key long, id long")
    got = nd._runs(rows, 4).collect()
    assert {(r["a"], r["b"]) for r in got if r["b"] is not None} == {(0, 1), (0, 2), (1, 2), (2509, 2510)}
    long = {(r["key"], r["a"]) for r in got if r["b"] is None}
    assert long == {(k, i) for i, k in enumerate(keys) if k in (2, 4)} and len(got) == 4 + len(long)
