"""Problem 9, on DataFrames: text quality statistics of documents.

Documents up to CHUNK characters are measured whole.  Longer ones are split into chunks,
which all tasks count, and the partial states merge in a tree: FANIN neighbours at a time,
until one state a document is left.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from . import prose

#: Characters of a chunk, and states that merge at once.
CHUNK, FANIN = 8192, 32
#: The most common words; their table is small and fixed.
MOST_WORDS = 100_000
STATS = (
    "doc_id long, word_count long, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, sentence_share double, natural_prose boolean"
)
_NAMES = [c.split()[0] for c in STATS.split(", ")]
_TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _stats_batch(ids: list, got: list[dict]) -> pa.RecordBatch:
    cols = [pa.array(ids, pa.int64())]
    for spec in STATS.split(", ")[1:]:
        name, kind = spec.split()
        cols.append(pa.array([g[name] for g in got], _TYPES[kind]))
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def common_words(spark: SparkSession, sf_dir: str) -> frozenset:
    """The fixed table of common words of all languages, in lower case."""
    rows = runtime.table(spark, sf_dir, "common_words").select(F.lower("word").alias("w")).where("w is not null").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return frozenset(r["w"] for r in rows)


def measured(docs: DataFrame, words: frozenset, chunk: int = CHUNK) -> DataFrame:
    """Statistics of every row of (doc_id, text), doc_id unique; other columns are not kept.

    Null, empty and blank texts have no words and null ratios, and are not judged.
    """
    docs = docs.select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(words)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for b in batches:
            yield _stats_batch(b.column(0).to_pylist(), [prose.measure(t, common) for t in b.column(1).to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = [text[i : i + chunk] for i in range(0, len(text), chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["doc_id", "no", "text"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for b in batches:
            states = [pickle.dumps(tuple(prose.count(t, common)), 5) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(states, pa.binary())], names=["doc_id", "no", "state"])

    def load(state: bytes) -> prose.Doc:
        d = prose.Doc(*pickle.loads(state))
        return d._replace(first=prose.Line(*d.first), last=prose.Line(*d.last))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for b in batches:
            out = []
            for parts in b.column(2).to_pylist():
                states = [load(p["state"]) for p in parts]
                total = states[0]
                for s in states[1:]:
                    total = prose.merge(total, s, common)
                out.append(pickle.dumps(tuple(total), 5))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "no", "state"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        for b in batches:
            yield _stats_batch(b.column(0).to_pylist(), [prose.finish(load(s), common) for s in b.column(2).to_pylist()])

    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = docs.where(~is_long).mapInArrow(whole, STATS)
    pieces = docs.where(is_long).mapInArrow(cut, "doc_id long, no int, text string").repartition("doc_id", "no")
    schema = "doc_id long, no int, state binary"
    states = runtime.checkpoint(pieces.mapInArrow(count, schema))
    parts = (states.agg(F.max("no")).first()[0] or 0) + 1
    while parts > 1:
        grouped = states.groupBy("doc_id", F.floor(F.col("no") / FANIN).cast("int").alias("no")).agg(F.sort_array(F.collect_list(F.struct("no", "state"))).alias("parts"))
        states = grouped.mapInArrow(merge, schema)
        parts = -(-parts // FANIN)
    return short.unionByName(states.mapInArrow(finish, STATS))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which less than half of the characters belong to sentences."""
    runtime.tune(spark)
    got = measured(runtime.table(spark, sf_dir, "documents"), common_words(spark, sf_dir))
    return got.where(~F.col("natural_prose")).select("doc_id").distinct()


def p9_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    runtime.tune(spark)
    return measured(runtime.table(spark, sf_dir, "documents"), common_words(spark, sf_dir))
