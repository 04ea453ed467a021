"""Pair counts against brute force."""

import json
import random
from collections import Counter
from itertools import combinations

import pytest

from lodestack.llm import cooccurrence


def _brute(records):
    n_ab = Counter(p for r in records for p in combinations(sorted(r), 2))
    n_a = Counter(t for r in records for t in r)
    return n_ab, n_a, len(records)


@pytest.fixture
def data():
    r = random.Random(4)
    items = [{"source_id": f"i{i}", "tags": [r.choice(["#Ab", "ab ", "Ｃ", "日本", "x", "y", "", None, "é", "É"]) for _ in range(r.randint(0, 6))]} for i in range(120)]
    comments = [{"comment_revision_id": f"c{i}", "tags_json": json.dumps([r.choice(["AB", "c", "é", "z", 7, None]) for _ in range(r.randint(0, 4))])} for i in range(60)]
    return items, comments


def test_equals_brute_force(spark, archive, data, monkeypatch):
    items, comments = data
    bad = [{"comment_revision_id": f"b{i}", "tags_json": v} for i, v in enumerate(["{}", "[", "", None, '"x"'])]
    d = archive(canonical_item=items + items[:20] + [{"source_id": "null", "tags": None}], comment_revision=comments + comments[:5] + bad)
    records = [{cooccurrence.tag_form(t) for t in x["tags"] if t} - {""} for x in items] + [{cooccurrence.tag_form(t) for t in json.loads(x["tags_json"]) if isinstance(t, str)} - {""} for x in comments]
    n_ab, n_a, n = _brute([r for r in records if r])
    want = {p: (k, n_a[p[0]], n_a[p[1]]) for p, k in n_ab.items()}
    read = lambda df: {(r["tag_a"], r["tag_b"]): (r["n_ab"], r["n_a"], r["n_b"]) for r in df.collect()}
    got = cooccurrence.p3_pairs(spark, d)
    assert read(got) == want
    r = got.first()
    a, b, c = r["n_ab"] + 0.5, r["n_a"] - r["n_ab"] + 0.5, r["n_b"] - r["n_ab"] + 0.5
    assert r["odds_ratio"] == pytest.approx(a * (n - r["n_a"] - r["n_b"] + r["n_ab"] + 0.5) / (b * c))
    monkeypatch.setattr(cooccurrence, "MAX_DICTIONARY", 3)  # more tags than tasks may hold
    monkeypatch.setattr(cooccurrence, "RUN", 50)  # many runs
    assert read(cooccurrence.p3_pairs(spark, d)) == want
    found = {tuple(x) for x in cooccurrence.p3_found(spark, d).collect()}
    assert found == {p for p, k in n_ab.items() if k >= 5 and k * 2000 >= n and k * n >= 6 * n_a[p[0]] * n_a[p[1]]}


def test_threshold_is_met_exactly(spark, archive):
    tags = [["a", "b"]] * 5 + [["x"]] * 25
    d = archive(canonical_item=[{"source_id": str(i), "tags": t} for i, t in enumerate(tags)])
    assert [tuple(r) for r in cooccurrence.p3_found(spark, d).collect()] == [("a", "b")]
    d = archive(canonical_item=[{"source_id": str(i), "tags": t} for i, t in enumerate(tags[:-1])])
    assert cooccurrence.p3_found(spark, d).count() == 0


def test_empty_tables(spark, archive):
    assert cooccurrence.p3_found(spark, archive()).count() == 0 and cooccurrence.p3_pairs(spark, archive()).count() == 0
