"""The transducer against stated cases and against normalisation of the standard library."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import consistent_text, lookalike


@pytest.mark.parametrize(
    "given_, want",
    [
        ("Ｄｏｎ＇ｔ", "Don't"), ("ﾘﾌｧｸﾀﾘﾝｸﾞ", "リファクタリング"), ("が", "が"), ("élève", "élève"), ("a\xa0b c　d", "a b c d"),
        ("x\u2010y\u2011z", "x-y-z"), ("mi\xadgra\u200btion\ufeff", "migration"), ("ﬁn maĳ ﬆop", "fin maij stop"), ("⼭小屋 ⻑い", "山小屋 長い"), ("\uf98e \u212a", "\u5e74 K"),
        ("РYТНОΝ", "PYTHON"), ("пpозpачный", "прозрачный"), ("デ一タ夕イプ", "データタイプ"), ("\u200c鉄道", "鉄道"), ("い\u200cぬ", "いぬ"),
        ("\u03f2at", "cat"), ("\u0261oogle", "google"), ("g\u0585\u0585gle", "google"), ("\u13aa\u13a2\u13a2LE", "ATTLE"), ("\U0001d400\U0001d401", "AB"), ("人エ知能", "人工知能"), ("na\u0457ve", "naïve"),
        ("e\u0302\u0301", "ế"), ("e\u0301\u0323", "ẹ\u0301"), ("\uff45\u0301", "é"), ("\u00ea\u0301", "ế"), ("A\u030a\u0301", "Ǻ"),
    ],
)
def test_cases(given_, want):
    assert lookalike.transduce(given_) == want and lookalike.inconsistent(given_)


@pytest.mark.parametrize("v", ["m² ½ ™ №5 H₂O ★", "ελληνικά", "новости", "\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "\U0001f469\u200d\U0001f4bb", "Tシャツ", "C言語", "データ入力", "スマホ口座", "夕方", "口コミ", "三カ国", "二ノ宮", "ՀԱՅ", "ᏣᎳᎩ", "ɡəʊ", "#Tag", "UPPER lower", "", None, "— 25 m²"])
def test_consistent_values_stay(v):
    assert lookalike.transduce(v) == v and not lookalike.inconsistent(v)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x30FF) | st.sampled_from("ｶﾞ゙‍́夕口一РеneaАÉ\U0001f469\U0001f4bb"), max_size=20))
def test_idempotent(v):
    once = lookalike.transduce(v)
    assert lookalike.transduce(once) == once
    assert unicodedata.normalize("NFC", once) == once


def test_mapping_has_no_conflicts():
    for source, target in lookalike.MAPPING.items():
        assert "".join(lookalike.MAPPING.get(c, c) for c in target) == target, source


def test_conflicts_are_found(monkeypatch):
    with pytest.raises(lookalike.ConflictError):
        lookalike.compile_mapping([("a", "ｘ", "x"), ("b", "ｘ", "y")])
    monkeypatch.setitem(lookalike.LOOK_ALIKES["L"], "a", "b")
    with pytest.raises(lookalike.ConflictError):
        lookalike.compile_contexts(lookalike.MAPPING)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeoyüêÅsſΑωиЙ", min_size=1, max_size=1), st.text(alphabet="\u0300\u0301\u0302\u0306\u0308\u030a\u0323\u0327\u0328\u0331\u0342\u0345", max_size=4))
def test_accents_compose_as_the_standard_says(base, marks):
    want = unicodedata.normalize("NFC", base + marks)
    assert lookalike.transduce(base + marks) in (want, want.replace("ſ", "s"))


def test_found(spark, archive):
    d = archive(
        canonical_item=[
            {"source_id": "a", "title": "ｘ", "tags": ["ok", None, "", "e\u0301"]}, {"source_id": "a", "title": "ｘ", "tags": ["ok", None, "", "e\u0301"]},
            {"source_id": "b", "title": None, "tags": None}, {"source_id": "c", "title": "fine", "tags": []}, {"source_id": "d", "title": "tab\there", "tags": ["x\n"]},
        ],
        comment_revision=[
            {"comment_revision_id": "r", "tags_json": '["ok", 5, "sc\\u0456kit", null]'}, {"comment_revision_id": "s", "tags_json": '{"a": "ｘ"}'}, {"comment_revision_id": "t", "tags_json": '["ｘ"'},
            {"comment_revision_id": "u", "tags_json": None}, {"comment_revision_id": "v", "tags_json": ""}, {"comment_revision_id": "w", "tags_json": '["a\\tb"]'},
        ],
    )
    got = sorted(map(tuple, consistent_text.p1_found(spark, d).collect()))
    assert got == [("tags", "a", 4), ("tags", "d", 1), ("tags_json", "r", 3), ("tags_json", "w", 1), ("title", "a", 0), ("title", "d", 0)]
    forms = {(r["field"], r["record_id"], r["pos"]): r["form"] for r in consistent_text.p1_consistent(spark, d).collect()}
    assert forms["tags_json", "r", 3] == "scikit" and forms["title", "c", 0] == "fine" and forms["tags", "a", 3] == ""


def test_empty_tables(spark, archive):
    d = archive()
    assert consistent_text.p1_found(spark, d).count() == 0 and consistent_text.p1_consistent(spark, d).count() == 0
