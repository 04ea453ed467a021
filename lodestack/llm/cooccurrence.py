"""Problem 3: pairs of tags that occur together, by an external sort of packed pair codes.

A tag's id is its rank by code point, so a pair (a, b) with a < b packs into the 64-bit code
``id(a) << 32 | id(b)``.  Tasks write sorted, run-length counted runs of codes; a shuffle by
code and Spark's external sorter, which spills and merges, bring equal codes together, and
one pass over the sorted codes adds up their runs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from . import lookalike

#: Codes that a task gathers before it sorts them into a run.
RUN = 1 << 21
#: Parameters of p3_found: least count of a pair, least share of records, least lift.
MIN_PAIR, MIN_SHARE, MIN_LIFT = 5, 2000, 6
#: Largest number of tags whose ids are held by every task; beyond it ids are joined.
MAX_DICTIONARY = 1 << 18


def tag_form(tag: str) -> str:
    """A tag in the form in which tags are compared; empty if nothing is left of it."""
    return lookalike.transduce(tag).strip().lstrip("#").strip().lower()


def record_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record: ``kind`` and ``record_id``, and the sorted set of its tags.

    Records are distinct source_id of canonical_item and comment_revision_id.  Null tags,
    tags_json that is null, broken or no list, and tags that normalise to nothing leave an
    empty set.  Should deliveries of one record differ in tags, the greatest set counts.
    """
    items = runtime.table(spark, sf_dir, "canonical_item").select(F.lit(0).alias("kind"), F.col("source_id").alias("record_id"), "tags", F.lit(None).cast("string").alias("tags_json"))
    comments = runtime.table(spark, sf_dir, "comment_revision").select(
        F.lit(1).alias("kind"), F.col("comment_revision_id").alias("record_id"), F.lit(None).cast("array<string>").alias("tags"), "tags_json"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}

        def form(t: str) -> str:
            got = memo.get(t)
            if got is None:
                if len(memo) > 200_000:
                    memo.clear()
                got = memo[t] = tag_form(t)
            return got

        for b in batches:
            out = []
            for tags, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if text:
                    try:
                        tags = json.loads(text)
                    except (ValueError, RecursionError):
                        tags = None
                    if not isinstance(tags, list):
                        tags = None
                out.append(sorted({form(t) for t in tags if isinstance(t, str)} - {""}) if tags else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], names=["kind", "record_id", "tags"])

    rows = items.unionByName(comments).where(F.col("record_id").isNotNull() & (F.col("tags").isNotNull() | F.col("tags_json").isNotNull()))
    found = rows.mapInArrow(run, "kind int, record_id string, tags array<string>").where(F.size("tags") > 0)
    return found.groupBy("kind", "record_id").agg(F.max("tags").alias("tags"))


def _with_ids(records: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with sorted arrays of tag ids, and (id, tag, n); ids are ranks by code point.

    Only the tags in ``counts`` have ids.  Up to MAX_DICTIONARY tags, a checked size, go to
    every task; more of them are ranked by a range sort and joined.
    """
    spark = records.sparkSession
    held = counts.limit(MAX_DICTIONARY + 1).collect()
    if len(held) <= MAX_DICTIONARY:
        # byte order of UTF-8 is the order of code points
        ordered = sorted(((r["tag"], r["n"]) for r in held), key=lambda x: x[0].encode("utf-8", "surrogatepass"))
        ids = spark.sparkContext.broadcast({t: i for i, (t, _) in enumerate(ordered)})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = ids.value
            for b in batches:
                out = [sorted(number[t] for t in tags if t in number) for tags in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["ids"])

        known = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(ordered)], "id int, tag string, n long")
        return records.select("tags").mapInArrow(run, "ids array<int>").where(F.size("ids") > 1), known
    parts = counts.repartitionByRange("tag").sortWithinPartitions("tag").withColumn("p", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id())
    parts = runtime.checkpoint(parts)
    sizes = {r["p"]: (r["low"], r["c"]) for r in parts.groupBy("p").agg(F.min("i").alias("low"), F.count("*").alias("c")).collect()}  # one row a partition
    start, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, start - sizes[p][0]))
        start += sizes[p][1]
    shift = spark.createDataFrame(offsets, "p int, shift long")
    known = parts.join(F.broadcast(shift), "p").select((F.col("i") + F.col("shift")).cast("int").alias("id"), "tag", "n")
    pairs = records.select("kind", "record_id", F.explode("tags").alias("tag")).join(known.select("id", "tag"), "tag")
    return pairs.groupBy("kind", "record_id").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1).select("ids"), known


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of pair codes with their counts."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["code", "n"])

    for b in batches:
        for ids in b.column(0).to_pylist():
            a = np.asarray(ids, np.int64)
            step = max(1, RUN // max(1, len(a)))  # a record of very many tags gives its pairs block by block
            for at in range(0, len(a) - 1, step):
                i, j = np.triu_indices(min(step, len(a) - at), 1, len(a) - at)
                held.append(a[at + i] << 32 | a[at + j])
                size += len(i)
                if size >= RUN:
                    yield from flush()
                    held, size = [], 0
    if held:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of equal codes, which stand side by side."""
    code, total = None, 0
    for b in batches:
        c, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(c):
            continue
        cut = np.flatnonzero(np.diff(c)) + 1
        starts = np.concatenate([[0], cut])
        codes, sums = c[starts].tolist(), np.add.reduceat(n, starts).tolist()
        if codes[0] == code:
            sums[0] += total
        elif code is not None:
            codes.insert(0, code)
            sums.insert(0, total)
        code, total = codes.pop(), sums.pop()
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(sums, pa.int64())], names=["code", "n_ab"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], names=["code", "n_ab"])


def pair_counts(records: DataFrame, min_tag: int = 1) -> tuple[DataFrame, int]:
    """Pairs with n_ab, n_a, n_b, lift and odds ratio, and the number of records.

    ``records`` holds sorted sets ``tags``, one row a record.  A pair cannot occur more often
    than its rarer tag, so tags below ``min_tag`` can be left out when no pair below it is
    wanted; nothing else is left out.  No records give no pairs.
    """
    n = records.count()
    counts = records.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= min_tag)
    numbered, known = _with_ids(records, counts)
    merged = (
        numbered.mapInArrow(_runs, "code long, n long").repartition("code").sortWithinPartitions("code").mapInArrow(_merge, "code long, n_ab long")
        .select(F.shiftright("code", 32).cast("int").alias("ia"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("ib"), "n_ab")
    )
    a = known.select(F.col("id").alias("ia"), F.col("tag").alias("tag_a"), F.col("n").alias("n_a"))
    b = known.select(F.col("id").alias("ib"), F.col("tag").alias("tag_b"), F.col("n").alias("n_b"))
    half = F.lit(0.5)  # the continuity correction
    n11, n10, n01 = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    n00 = F.lit(n) - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    out = merged.join(a, "ia").join(b, "ib").select(
        "tag_a", "tag_b", "n_ab", "n_a", "n_b",
        (F.col("n_ab") * F.lit(float(n)) / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        ((n11 + half) * (n00 + half) / ((n10 + half) * (n01 + half))).alias("odds_ratio"),
    )
    return out, n


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tags that occur together often, and much more often than chance."""
    runtime.tune(spark)
    records = runtime.checkpoint(record_tags(spark, sf_dir))
    n = records.count()
    least = max(MIN_PAIR, -(-n // MIN_SHARE))
    pairs, n = pair_counts(records, least)
    wanted = (F.col("n_ab") >= MIN_PAIR) & (F.col("n_ab") * MIN_SHARE >= n)
    beyond = F.col("n_ab").cast("decimal(20,0)") * n >= F.col("n_a").cast("decimal(20,0)") * F.col("n_b") * MIN_LIFT
    return pairs.where(wanted & beyond).select("tag_a", "tag_b")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of tags with its counts, lift and odds ratio."""
    runtime.tune(spark)
    records = runtime.checkpoint(record_tags(spark, sf_dir))
    return pair_counts(records)[0]
