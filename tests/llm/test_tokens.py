"""Ids against the tokenizer applied to whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from lodestack.llm import corpus_tokens, tokens  # noqa: E402

ODD = ["", " ", "\n\n \t", "<|endoftext|>", "don't 's 'll it''s", "日本語の文章。テスト", "a" * 3000, "あ" * 3000, "x y\x85z", "emoji 👩‍💻!", "1234567890" * 50, "tail  ", "\ud800", "²³ Ⅳ ½"]


def _whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def _long(seed):
    r = random.Random(seed)
    return "".join(r.choice(["word ", "It's ", "日本語。", "\n", "  ", "42,", "naïve "]) for _ in range(2000))


def test_chunks_give_the_ids_of_the_whole():
    texts = [t for t in ODD if t != "\ud800"] + [_long(i) for i in range(4)]
    e = tokens.Encoder()
    for text, want in zip(texts, _whole(texts)):
        assert e.text(text) == want == tokens.encode_in_chunks(e, text)
        assert len(text) < 5000 or len(tokens.cuts(text)) > 3


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120), st.lists(st.integers(1, 119), max_size=6))
def test_any_cut_is_repaired(text, at):
    text = text.encode("utf-8", "replace").decode()
    if not text:
        return
    e = tokens.Encoder()
    ends = sorted({i for i in at if i < len(text)} | {len(text)})
    parts = [e.chunk(text[a:b]) for a, b in zip([0, *ends], ends)]
    assert e.joined(text, ends, parts) == e.text(text)


def test_shared_chunks(spark, archive):
    common = _long(9)
    texts = [common, common, "head " + common, common + " tail", _long(10) + common, None, *[t for t in ODD if t != "\ud800"]]
    d = archive(documents=[{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["ids"] for r in corpus_tokens.p7_ids(spark, d).collect()}
    assert got == dict(enumerate(_whole([t or "" for t in texts])))
    assert corpus_tokens.p7_ids(spark, archive()).count() == 0
