"""Statistics against simple counts, and of pieces against whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import prose, text_quality

COMMON = frozenset("the a of and in to was is it die der und le la et os e не и в на の は が を に から".split())
PROSE = "The valve was replaced in the winter, and it is fine. Nobody in the town said a word of it to the mayor."
JUNK = ["- nightly teapot\n- urban courtyard\n- coastal library", "a;b;c\n1;2;3\n$5;€6;7", "2025-01-02T03:04:05Z INFO [x] fetch id=1 status=200", "1 22 333 4444 55555", "def f(x):\n    return [x]", "=>!-_%★^>", "beehive #tastai #rag #old notebook #web"]
REAL = [PROSE, "三階で見つけた隧道を釣り合わせた。この灯台には64件の温室が登録されている。", "- It is in the house, and the door was open.\n- It was the end of the road.", "Ann: It was in the house.\nBob: And it is still in the house.", "we found the old map in the house and it was fine"]


@pytest.mark.parametrize("text", JUNK)
def test_junk(text):
    assert prose.measure(text, COMMON)["natural_prose"] is False


@pytest.mark.parametrize("text", REAL)
def test_prose(text):
    assert prose.measure(text, COMMON)["natural_prose"] is True


def test_ratios():
    got = prose.measure("The cat, it sat.\nno end\n\n", COMMON)
    assert (got["word_count"], got["mean_word_length"], got["punctuated_lines"], got["common_words"]) == (6, 16 / 6, 0.5, 2 / 6)
    assert got["symbol_ratio"] == 2 / 18
    for blank in (None, "", " \n\t"):
        m = prose.measure(blank, COMMON)
        assert m["word_count"] == 0 and m["natural_prose"] is None and m["mean_word_length"] is None


def _merged(text, cuts, order):
    ends = [0, *sorted({c % (len(text) + 1) for c in cuts}), len(text)]
    states = [prose.count(text[a:b], COMMON) for a, b in zip(ends, ends[1:])]
    r = random.Random(order)
    while len(states) > 1:
        i = r.randrange(len(states) - 1)
        states[i : i + 2] = [prose.merge(states[i], states[i + 1], COMMON)]
    return prose.finish(states[0], COMMON)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aTe thé 日本のカナー.。!?”\"-#12\n;x", max_size=80), st.lists(st.integers(0, 200), max_size=6), st.integers(0, 5))
def test_pieces_equal_the_whole(text, cuts, order):
    assert _merged(text, cuts, order) == prose.measure(text, COMMON)


def test_real_texts_in_pieces():
    for text in [*JUNK, *REAL, "\n\n".join(REAL + JUNK), "x" * 500, PROSE * 30]:
        for seed in range(10):
            r = random.Random(seed)
            assert _merged(text, [r.randrange(10**6) for _ in range(5)], seed) == prose.measure(text, COMMON)


def test_found(spark, archive):
    long = "\n".join([PROSE, *JUNK] * 60)
    texts = [PROSE, *JUNK, None, "", " ", long, PROSE]
    d = archive(documents=[{"doc_id": i, "text": t} for i, t in enumerate(texts)], common_words=[{"lang": "en", "word": w} for w in COMMON])
    got = {r["doc_id"]: r for r in text_quality.p9_stats(spark, d).collect()}
    assert len(got) == len(texts)
    small = {r["doc_id"]: r for r in text_quality.measured(spark.read.parquet(f"{d}/documents.parquet"), COMMON, chunk=50).collect()}
    for i, t in enumerate(texts):
        want = prose.measure(t, COMMON)
        assert {k: got[i][k] for k in want} == want == {k: small[i][k] for k in want}
    assert sorted(r["doc_id"] for r in text_quality.p9_found(spark, d).collect()) == [i for i, t in enumerate(texts) if prose.measure(t, COMMON)["natural_prose"] is False]
    assert text_quality.p9_stats(spark, archive()).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["the ", "it is", "f(", ")", ";", "=$", "=", "$", "|", " | ", "http", "https://", "x", " ", "   ", ".", "”", '"', "は", "\n", "a" * 30, " " * 45, "git "]), max_size=14).map("".join), st.lists(st.integers(0, 400), max_size=6), st.integers(0, 5))
def test_signs_of_code_in_pieces(text, cuts, order):
    assert _merged(text, cuts, order) == prose.measure(text, COMMON)


def test_lines_are_judged_whole():
    assert prose.measure('System.err.println("The file is in the house. It is on the path and it was there");', COMMON)["natural_prose"] is False
    remark = "we found it in the house, and it was; then the rest of an old town is fine"
    assert remark[36] == ";"
    assert prose.measure("so " + remark, COMMON)["natural_prose"] is True
    closed = prose.measure("It is in the house." + ")" * 50 + " " * 50, COMMON)
    assert closed["punctuated_lines"] == 1.0


def test_remarks_count_whatever_their_number():
    said = ["we found the old map in the house and it was fine", "nobody in the town said a word of it to the mayor", "夏を通して、私は古い地図をこの家に移したうえで予算も描いた"]
    for lines in (said, said * 3, [f"- {x}" for x in said * 40], [said[0]] * 5):
        assert prose.measure("\n".join(lines), COMMON)["sentence_share"] == 1.0
    headlines = ["The Old Map Of The House And A Town In Winter", "夏を通して古い地図をこの家に移したうえで描いた予算の図書館"]
    assert prose.measure("\n".join(headlines * 2), COMMON)["sentence_share"] == 0.0


def test_many_cuts_change_nothing():

    r = random.Random(4)
    common = frozenset("the of and was in の は を".split())
    lines = ["22. ハロトの借り物のデータセット https://dai.example/x", "The valve was replaced. ”Nobody” minded (he said)... Really?! ", "x = f(a); y = $b", "| a | b |", "日本語の文章です。次の文も、長い。", "- and so it was in the end, said one of them to the other", "  ", "3.14 is not a stop."]
    for _ in range(400):
        text = "\n".join(r.choice(lines) for _ in range(r.randint(1, 6)))
        cuts = sorted({0, len(text), *(r.randint(0, len(text)) for _ in range(r.choice([1, 5, 50, 150])))})
        states = [prose.count(text[a:b], common) for a, b in zip(cuts, cuts[1:])]
        total = states[0] if states else prose.count(text, common)
        for state in states[1:]:
            total = prose.merge(total, state, common)
        assert prose.finish(total, common) == prose.measure(text, common), [text[a:b] for a, b in zip(cuts, cuts[1:])]
