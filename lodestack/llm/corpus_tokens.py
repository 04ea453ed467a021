"""Problem 7, on DataFrames: the whole corpus as ids of a public tokenizer.

Chunks are found by content; those whose hash occurs more than once are encoded once, by the
document that holds the first of them, and lent to all documents that hold them.  Everything
else is encoded where it stands, and the joins of chunks are repaired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from . import tokens

VOCABULARY = "byte_bpe_50k"


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def chunk_refs(docs: DataFrame) -> DataFrame:
    """doc_id, number and hash of every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, numbers, hashes = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text, start = _clean(text), 0
                for k, end in enumerate(tokens.cuts(text)):
                    ids.append(doc)
                    numbers.append(k)
                    hashes.append(tokens.chunk_hash(text[start:end]))
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64())], names=["doc_id", "no", "hash"])

    return docs.where(F.length("text") > 0).select("doc_id", "text").mapInArrow(run, "doc_id long, no int, hash long")


def _lend(docs: DataFrame, vocabulary: str, folder: str | None) -> DataFrame:
    """hash and ids of the chunks that documents (doc_id, text, lends) lend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(vocabulary, folder)
        for b in batches:
            hashes, ids = [], []
            for text, lends in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = _clean(text)
                ends = [0, *tokens.cuts(text)]
                for k in lends:
                    chunk = text[ends[k] : ends[k + 1]]
                    hashes.append(tokens.chunk_hash(chunk))
                    ids.append(encoder.chunk(chunk))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["hash", "ids"])

    return docs.select("text", "lends").mapInArrow(run, "hash long, ids array<int>")


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """doc_id and ids of every row of (doc_id, text).

    The ids of a null or empty text are an empty list; blank texts have the ids of their
    spaces.  doc_id has to be unique; other columns are not kept.
    """
    docs = docs.select("doc_id", "text")
    # both joins below are on the same rows, so one shuffle of the texts serves them
    texts = docs.where((F.length("text") > 0) & F.col("doc_id").isNotNull())
    others = docs.where(~F.coalesce((F.length("text") > 0) & F.col("doc_id").isNotNull(), F.lit(False)))
    refs = runtime.checkpoint(chunk_refs(texts))  # read twice
    shared = refs.groupBy("hash").agg(F.count("*").alias("uses"), F.min(F.struct("doc_id", "no")).alias("owner")).where(F.col("uses") > 1).select("hash", "owner")
    uses = runtime.checkpoint(refs.join(shared, "hash").select("hash", "doc_id", "no", (F.col("owner") == F.struct("doc_id", "no")).alias("owns")))
    lends = uses.where("owns").groupBy("doc_id").agg(F.sort_array(F.collect_list("no")).alias("lends"))
    lent = _lend(texts.join(lends, "doc_id"), vocabulary, folder)
    borrowed = uses.select("hash", "doc_id", "no").join(lent, "hash").groupBy("doc_id").agg(F.collect_list(F.struct("no", "ids")).alias("borrowed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(vocabulary, folder)
        for b in batches:
            out = []
            for text, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.append(tokens.encode_in_chunks(encoder, text, {p["no"]: p["ids"] for p in parts}) if parts else encoder.text(_clean(text)) if text else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    joined = texts.join(borrowed, "doc_id", "left").select("doc_id", "text", "borrowed")
    alone = others.withColumn("borrowed", F.lit(None).cast(joined.schema["borrowed"].dataType))
    return joined.mapInArrow(run, "doc_id long, ids array<int>").unionByName(alone.mapInArrow(run, "doc_id long, ids array<int>"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k, without special tokens."""
    runtime.tune(spark)
    return encoded(runtime.table(spark, sf_dir, "documents"))
