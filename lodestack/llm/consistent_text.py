"""Problem 1, on DataFrames: titles and tags in one consistent form."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from . import lookalike
from .spark_text import per_batch

VALUE = "field string, record_id string, pos int, value string"


def _parse_list(text: str | None) -> list:
    """The entries of a JSON list; anything else has none."""
    if not text:
        return []
    try:
        got = json.loads(text)
    except (ValueError, RecursionError):
        return []
    return got if isinstance(got, list) else []


def decoded_tags(comments: DataFrame, only_suspects: bool = False) -> DataFrame:
    """Every string in tags_json with its 1-based place in the decoded list.

    Null, empty and broken JSON, and JSON that is no list, give no rows; entries that are no
    strings are left out but keep their place.  ``only_suspects`` leaves out, before
    decoding, lists of plain ASCII without escapes, which are consistent already.
    """
    rows = comments.select("comment_revision_id", "tags_json").where(F.col("tags_json").isNotNull())
    if only_suspects:
        rows = rows.where(F.col("tags_json").rlike(r"[^ -~]|\\"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, places, values = [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, v in enumerate(_parse_list(text), 1):
                    if isinstance(v, str):
                        ids.append(rid)
                        places.append(i)
                        values.append(v.encode("utf-8", "replace").decode("utf-8"))
            return pa.RecordBatch.from_arrays(
                [pa.array(["tags_json"] * len(ids), pa.string()), pa.array(ids, pa.string()), pa.array(places, pa.int32()), pa.array(values, pa.string())],
                names=["field", "record_id", "pos", "value"],
            )

        return f

    return per_batch(rows, make, VALUE)


def item_values(items: DataFrame) -> DataFrame:
    """Titles (place 0) and tags (1-based places) of canonical_item; nulls give no rows."""
    title = F.array(F.struct(F.lit("title").alias("field"), F.lit(0).alias("pos"), F.col("title").alias("value")))
    tags = F.transform(
        F.coalesce("tags", F.array().cast("array<string>")),
        lambda t, i: F.struct(F.lit("tags").alias("field"), (i + 1).alias("pos"), t.alias("value")),
    )
    return (
        items.select(F.col("source_id").alias("record_id"), F.filter(F.concat(title, tags), lambda v: v["value"].isNotNull()).alias("v"))
        .select("record_id", F.explode("v").alias("v"))
        .select("v.field", "record_id", "v.pos", "v.value")
    )


def values(spark: SparkSession, sf_dir: str, only_suspects: bool = False) -> DataFrame:
    """All titles and tags of both tables, ``only_suspects`` without plain ASCII."""
    items = item_values(runtime.table(spark, sf_dir, "canonical_item"))
    if only_suspects:
        items = items.where(~F.col("value").rlike(rf"^{lookalike.PLAIN_JAVA}\z"))
    return items.unionByName(decoded_tags(runtime.table(spark, sf_dir, "comment_revision"), only_suspects))


def with_form(df: DataFrame, changed_only: bool = False) -> DataFrame:
    """Adds ``form``, the consistent form of ``value``; null stays null.

    Values recur, so each task keeps the forms it has found.  Columns beside field,
    record_id, pos and value are not kept.
    """

    def make():
        memo: dict[str, str] = {}

        def form(v: str | None) -> str | None:
            got = memo.get(v) if v is not None else None
            if got is None and v is not None:
                if len(memo) > 200_000:
                    memo.clear()
                got = memo[v] = lookalike.transduce(v)
            return got

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            old = batch.column(3).to_pylist()
            new = [form(v) for v in old]
            if changed_only:
                keep = pa.array([i for i, (a, b) in enumerate(zip(old, new)) if a != b], pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*(c.take(keep) for c in batch.columns), pa.array([new[i.as_py()] for i in keep], pa.string())],
                    names=[*batch.schema.names, "form"],
                )
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=[*batch.schema.names, "form"])

        return f

    return per_batch(df.select("field", "record_id", "pos", "value"), make, f"{VALUE}, form string")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and tags that are not in the consistent form.

    Null titles and tags, empty strings and tables without rows give none; copies and older
    states of a record give one row.
    """
    runtime.tune(spark)
    return with_form(values(spark, sf_dir, only_suspects=True), changed_only=True).select("field", "record_id", "pos").distinct()


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and tag beside its consistent form, one row a place of a record."""
    runtime.tune(spark)
    return with_form(values(spark, sf_dir)).distinct()
