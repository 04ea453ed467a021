"""Problem 5, on DataFrames: garbled texts and payloads, and what could be restored."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from . import mojibake
from .spark_text import per_batch

#: Texts without any of this cannot be garbled and stay in the JVM.
_MAY_BE = r"[^\x00-\x7f]|&[A-Za-z#]|\\u"


def examined(texts: DataFrame, garbled_only: bool = True, restore: bool = True) -> DataFrame:
    """Adds ``garbled`` and, if asked for, ``restored`` to (table_name, record_id, text, encoding).

    ``encoding`` is the encoding that the record names; edges of the search that undo it are
    cheaper.  It may be null, empty or unknown.  Null and empty texts are sound.  ``restored`` is
    the text as far as it could be had.  Other columns are not kept; repeated rows are judged each.
    """
    texts = texts if "encoding" in texts.columns else texts.withColumn("encoding", F.lit(None).cast("string"))

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [mojibake.examine(t, e) for t, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            keep = [i for i, g in enumerate(got) if g[0] or not garbled_only]
            at = pa.array(keep, pa.int64())
            cols = [batch.column(0).take(at), batch.column(1).take(at), pa.array([got[i][0] for i in keep], pa.bool_())]
            names = ["table_name", "record_id", "garbled"]
            if restore:
                cols.append(pa.array([got[i][1] for i in keep], pa.string()))
                names.append("restored")
            return pa.RecordBatch.from_arrays(cols, names=names)

        return f

    schema = "table_name string, record_id string, garbled boolean" + ", restored string" * restore
    return per_batch(texts.select("table_name", "record_id", "text", "encoding"), make, schema)


def examined_payloads(payloads: DataFrame, wrong_only: bool = True) -> DataFrame:
    """Payloads with ``garbled`` (whether the charset is wrong) and ``restored`` (their text).

    A null content or an empty charset is no case; bytes in ASCII never are.
    """

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [mojibake.wrong_charset(c, s) for c, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            keep = [i for i, g in enumerate(got) if g[0] or not wrong_only]
            return pa.RecordBatch.from_arrays(
                [pa.array(["payload"] * len(keep), pa.string()), batch.column(0).take(pa.array(keep, pa.int64())), pa.array([got[i][0] for i in keep], pa.bool_()), pa.array([got[i][1] for i in keep], pa.string())],
                names=["table_name", "record_id", "garbled", "restored"],
            )

        return f

    return per_batch(payloads.select("payload_id", "content", "charset"), make, "table_name string, record_id string, garbled boolean, restored string")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_markdown and page_fetch.text of which some place may be garbled."""
    revisions = runtime.table(spark, sf_dir, "resource_revision").select(F.lit("resource_revision").alias("table_name"), F.col("resource_revision_id").alias("record_id"), F.col("content_markdown").alias("text"), F.lit(None).cast("string").alias("encoding"))
    pages = runtime.table(spark, sf_dir, "page_fetch").select(F.lit("page_fetch").alias("table_name"), F.col("page_fetch_id").alias("record_id"), "text", F.col("content_encoding").alias("encoding"))
    return revisions.unionByName(pages).where(F.col("text").rlike(_MAY_BE))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are garbled in whole or in part, and payloads with a wrong charset."""
    runtime.tune(spark)
    bad = examined(texts(spark, sf_dir), restore=False).select("table_name", "record_id")
    payloads = examined_payloads(runtime.table(spark, sf_dir, "payload").where(F.col("charset").isNotNull() & (F.trim("charset") != "")))
    return bad.unionByName(payloads.select("table_name", "record_id")).distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with their original text where it can be had, one row a record."""
    runtime.tune(spark)
    bad = examined(texts(spark, sf_dir)).unionByName(examined_payloads(runtime.table(spark, sf_dir, "payload")))
    return bad.select("table_name", "record_id", "restored").distinct()
