"""Problem 6, on DataFrames: template residue, filler, error pages and script demands."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from . import residue
from .spark_text import per_batch


def classified(texts: DataFrame, reports: bool = False, found_only: bool = True) -> DataFrame:
    """Adds ``kind`` to (table_name, record_id, text): what residue a text is or holds.

    Null, empty and blank texts have none.  ``reports`` reads the text as a warning or error
    of the collector, whose own reports are none.
    """

    def make():
        judge = residue.classify_report if reports else residue.classify
        memo: dict[str, str | None] = {}

        def kind(t: str | None) -> str | None:
            if not reports or t is None:
                return judge(t)
            if t not in memo:  # reports recur
                if len(memo) > 50_000:
                    memo.clear()
                memo[t] = judge(t)
            return memo[t]

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [kind(t) for t in batch.column(2).to_pylist()]
            keep = [i for i, g in enumerate(got) if g or not found_only]
            at = pa.array(keep, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([got[i] for i in keep], pa.string())], names=["table_name", "record_id", "kind"])

        return f

    return per_batch(texts.select("table_name", "record_id", "text"), make, "table_name string, record_id string, kind string")


def _texts(spark: SparkSession, sf_dir: str, name: str, key: str, column: str) -> DataFrame:
    return runtime.table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(key).alias("record_id"), F.col(column).alias("text")).where(F.length("text") > 0)


def residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = classified(_texts(spark, sf_dir, "resource_revision", "resource_revision_id", "content_markdown"))
    reports = _texts(spark, sf_dir, "fetch_capture", "fetch_capture_id", "warning").unionByName(_texts(spark, sf_dir, "page_fetch", "page_fetch_id", "error"))
    return bodies.unionByName(classified(reports, reports=True))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are or hold such residue, to be left out."""
    runtime.tune(spark)
    return residues(spark, sf_dir).select("table_name", "record_id").distinct()


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records, each with the kind of its residue."""
    runtime.tune(spark)
    return residues(spark, sf_dir).distinct()
