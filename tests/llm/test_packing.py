"""Packs hold what they may, nothing is lost, and little room is left."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=20))
def test_plan_places_everything(capacity, histogram):
    histogram = {k: v for k, v in histogram.items() if k <= capacity}
    rules, patterns = packing.plan(histogram, capacity)
    packs = sum(patterns.values())
    fill, ranks, held = Counter(), defaultdict(list), defaultdict(Counter)
    for r in rules:
        for p in range(r.packs):
            fill[r.pack + p] += r.each * r.length
            held[r.pack + p][r.length] += r.each
        ranks[r.length].append((r.rank, r.each * r.packs))
    assert set(fill) == set(range(packs)) and all(v <= capacity for v in fill.values())
    for length, n in histogram.items():
        at = 0
        for start, size in sorted(ranks[length]):
            assert start == at
            at += size
        assert at == n
    assert Counter(tuple(sorted(x.items(), reverse=True)) for x in held.values()) == patterns
    total = sum(k * v for k, v in histogram.items())
    assert packs <= 2 * total / capacity + 1


def test_plan_wastes_little():
    r = random.Random(2)
    h = Counter(min(2048, int(r.lognormvariate(5.5, 1)) + 1) for _ in range(20000))
    _, patterns = packing.plan(h, 2048)
    assert sum(k * v for k, v in h.items()) / (sum(patterns.values()) * 2048) > 0.99
    with pytest.raises(ValueError):
        packing.plan({0: 1}, 5)
    with pytest.raises(ValueError):
        packing.plan({6: 1}, 5)


def test_shortest_pack_first():
    # the 2 would fill the pack of 8, but that of 5 has more room
    assert packing.plan({8: 1, 5: 1, 2: 1}, 10)[1] == {((8, 1),): 1, ((5, 1), (2, 1)): 1}
    assert packing.plan({5: 3}, 10)[1] == {((5, 2),): 1, ((5, 1),): 1} and packing.plan({}, 10) == ([], {})


def test_packed_rows(spark):
    r = random.Random(1)
    sizes = [(i, 100 if i % 3 == 0 else r.randint(0, 700)) for i in range(600)] + [(600, None), (601, 256), (602, 512)]  # a third share one length
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    caps = {"tiny": 256, "mid": 512}
    got = packing.packed(df, caps).collect()
    for c, cap in caps.items():
        own = [x for x in got if x["container"] == c]
        by_doc, fill = defaultdict(list), Counter()
        for x in own:
            by_doc[x["doc_id"]].append(x)
            if x["pack_id"] is not None:
                fill[x["pack_id"]] += x["tokens"]
        assert set(by_doc) == {i for i, _ in sizes} and max(fill.values()) <= cap and set(fill) == set(range(len(fill)))
        for i, n in sizes:
            n = n or 0
            assert sum(x["tokens"] for x in by_doc[i]) == n and len(by_doc[i]) == max(1, -(-n // cap))
            assert sorted(x["piece"] for x in by_doc[i]) == list(range(max(1, -(-n // cap))))
            assert (n == 0) == (by_doc[i][0]["pack_id"] is None)
        assert sum(fill.values()) / (len(fill) * cap) > 0.95


def test_queries(spark, archive):
    pytest.importorskip("public_tokenizers")
    docs = [{"doc_id": 1, "text": "a b c"}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": None}, {"doc_id": 4, "text": "word " * 700}]
    d = archive(documents=docs, pack_capacity=[{"container": "tiny", "capacity_tokens": 256}, {"container": "none", "capacity_tokens": None}])
    got = packing.p8_packs(spark, d).collect()
    assert sum(x["tokens"] for x in got if x["doc_id"] == 4) == 701 and {x["doc_id"] for x in got} == {1, 2, 3, 4}
    fill = packing.p8_fill(spark, d).collect()
    assert len(fill) == 1 and fill[0]["fullest"] <= 256
    assert packing.p8_packs(spark, archive()).count() == 0
