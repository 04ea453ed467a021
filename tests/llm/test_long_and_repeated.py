"""Very long texts, many repetitions and hot keys through every operator."""

import json

import pytest

from lodestack.llm import consistent_text, cooccurrence, encoding_repair, lookalike, main_content, near_duplicates, residue_filter, text_quality

SENTENCE = "The valve was replaced over the winter, and nobody at Hallam minded the noise. "


def test_long_title_and_many_tags(spark, archive):
    long = "déjà vu " * 20_000
    tags = [f"t{i:03}" for i in range(300)]
    d = archive(canonical_item=[{"source_id": "a", "title": long + "ｘ", "tags": tags}, {"source_id": "b", "title": long, "tags": tags}] * 3, comment_revision=[{"comment_revision_id": "c", "tags_json": json.dumps(tags[:2])}] * 5)
    assert [tuple(r) for r in consistent_text.p1_found(spark, d).collect()] == [("title", "a", 0)]
    assert lookalike.transduce(long + "ｘ") == long + "x"
    pairs = {(r["tag_a"], r["tag_b"]): r["n_ab"] for r in cooccurrence.p3_pairs(spark, d).collect()}
    assert len(pairs) == 300 * 299 // 2 and pairs["t000", "t001"] == 3 and pairs["t000", "t299"] == 2


def test_long_pages(spark, archive):
    body = "\n\n".join(SENTENCE * 4 + str(i) for i in range(4000))
    page = f"Home | Search | Contact\n{body}\nBack to top"
    other = [{"page_fetch_id": f"o{i}", "url": f"https://h{i % 5}.test/", "text": f"Home | Search | Contact\n{SENTENCE.replace('valve', 'x' * i)}{SENTENCE * i}\nBack to top"} for i in range(9)]
    d = archive(page_fetch=[{"page_fetch_id": "p", "url": "https://a.test/", "text": page}] * 4 + other, resource_revision=[{"resource_revision_id": "r", "title": None, "content_markdown": page + " {{ title }}"}, {"resource_revision_id": "s", "title": None, "content_markdown": page + "\ncafÃ©"}])
    lines = page.count("\n") + 1
    found = {(r["record_id"], r["line_no"]) for r in main_content.p2_found(spark, d).collect()}
    assert {("p", 1), ("p", lines), ("r", 1), ("s", 1), ("s", lines)} <= found and len([x for x in found if x[0] == "p"]) == 2
    assert {tuple(r) for r in near_duplicates.p4_found(spark, d).collect()} == {("r", "s")}
    assert {tuple(r) for r in encoding_repair.p5_found(spark, d).collect()} == {("resource_revision", "s")}
    assert {tuple(r) for r in residue_filter.p6_found(spark, d).collect()} == {("resource_revision", "r")}


def test_copies_of_one_revision_hold_a_third(spark, archive):
    text = SENTENCE * 5
    rows = [{"resource_revision_id": f"c{i:03}", "title": "T", "content_markdown": text} for i in range(60)]
    rows += [{"resource_revision_id": f"o{i:03}", "title": "T", "content_markdown": " ".join(f"word{i}x{j}" for j in range(60))} for i in range(120)]
    d = archive(resource_revision=rows)
    groups = near_duplicates.p4_groups(spark, d).collect()
    assert len(groups) == 180 and sum(r["group_id"] == "c000" for r in groups) == 60 and all(r["links"] == 0 for r in groups)
    assert near_duplicates.p4_found(spark, d).count() == 60 * 59 // 2


@pytest.mark.parametrize("chunk", [64, 1000])
def test_long_documents_in_chunks(spark, archive, chunk):
    from lodestack.llm import prose

    common = frozenset(["the", "was", "and", "at", "over"])
    texts = [SENTENCE * 3000, "x" * 100_000, "日本語の文章です。" * 9000, "\n" * 50_000]
    d = archive(documents=[{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in text_quality.measured(spark.read.parquet(f"{d}/documents.parquet"), common, chunk).collect()}
    for i, t in enumerate(texts):
        want = prose.measure(t, common)
        assert {k: got[i][k] for k in want} == want
