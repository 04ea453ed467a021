"""Queries of the training-data operators, by name.

Their rows come from automata, searches and trees that SQL cannot express, or whose SQL is too
slow on whole tables; tests/llm compares each with brute force on small fixtures.  SQL is
given where it can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import consistent_text, cooccurrence, corpus_tokens, encoding_repair, main_content, near_duplicates, packing, residue_filter, text_quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": consistent_text.p1_found,
        "p1_consistent": consistent_text.p1_consistent,
        "p2_found": main_content.p2_found,
        "p2_main": main_content.p2_main,
        "p3_found": cooccurrence.p3_found,
        "p3_pairs": cooccurrence.p3_pairs,
        "p4_found": near_duplicates.p4_found,
        "p4_groups": near_duplicates.p4_groups,
        "p5_found": encoding_repair.p5_found,
        "p5_restored": encoding_repair.p5_restored,
        "p6_found": residue_filter.p6_found,
        "p6_kinds": residue_filter.p6_kinds,
        "p7_ids": corpus_tokens.p7_ids,
        "p8_packs": packing.p8_packs,
        "p8_fill": packing.p8_fill,
        "p9_found": text_quality.p9_found,
        "p9_stats": text_quality.p9_stats,
    }


_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL = {
    "p4_found": f"""WITH r AS (SELECT DISTINCT resource_revision_id AS id, coalesce(title, '') || content_markdown AS raw FROM resource_revision WHERE length(content_markdown) >= 300),
n AS (SELECT id, translate(replace(replace(replace(replace(raw, ' ', ''), chr(9), ''), chr(13), ''), chr(10), ''), '{_UP}', '{_UP.lower()}') AS t FROM r),
g AS (SELECT DISTINCT id, substr(t, i, 8) AS gram FROM (SELECT id, t, unnest(range(1, length(t) - 6)) AS i FROM n)), c AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS both_n FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY a.id, b.id)
SELECT x AS revision_a, y AS revision_b FROM p JOIN c cx ON cx.id = x JOIN c cy ON cy.id = y WHERE both_n >= 0.6 * (cx.n + cy.n - both_n)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
