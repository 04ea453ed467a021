"""Problem 8: packing by shortest-pack-first over the histogram of lengths.

The driver sees only the histogram, which has at most as many entries as the capacity has
tokens.  It places lengths, longest first, each into the shortest packs, those with the most
room, or into new ones if even these have too little.  Packs of one pattern (the lengths in
them) are counted, never listed: a step moves a number of packs from one pattern to the next
and hands back a rule: for a length, a run of ranks and the packs that take them.  The rows
find their pack by their rank among those of equal length, and ranks are counted per salt
first, so a length that a third of all rows share is ranked by all tasks.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import runtime
from . import tokens
from .corpus_tokens import VOCABULARY, _clean


#: Rows of one length that one task ranks at a time, on average.
ROWS_A_SALT = 200_000


class Rule(NamedTuple):
    """Pieces of ``length`` with ranks from ``rank`` on, ``each`` a pack, go to ``packs`` packs from ``pack`` on."""

    length: int
    rank: int
    each: int
    pack: int
    packs: int


#: Lengths in a pack, longest first, each with how often it is in it.
Pattern = tuple[tuple[int, int], ...]


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Rule], Counter[Pattern]]:
    """Rules that place every length of a histogram, and how many packs have each pattern.

    Lengths must lie between 1 and the capacity.  An empty histogram needs no packs.
    """
    open_runs: dict[int, list[tuple[int, int, Pattern]]] = {}  # room -> first pack, number of packs, pattern
    rooms: list[int] = []  # the keys, sorted
    full: Counter[Pattern] = Counter()
    rules: list[Rule] = []
    packs = 0

    def put(room: int, first: int, number: int, pattern: Pattern) -> None:
        if not room:
            full[pattern] += number
            return
        if room not in open_runs:
            open_runs[room] = []
            insort(rooms, room)
        open_runs[room].append((first, number, pattern))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        if left < 0 or not 1 <= length <= capacity:
            raise ValueError(f"length {length} of {left} pieces for a capacity of {capacity}")
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]  # the shortest packs
                first, number, pattern = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room]
                    rooms.pop()
                # as many pieces as keep them the shortest, or as there are
                each = (room - (rooms[-1] if rooms else 0)) // length
                each = max(1, min(each, room // length, left // number))
            else:
                room, pattern = capacity, ()
                each = min(left, capacity // length)  # a new pack stays the shortest until it is full
                first, number = packs, left // each
                packs += number
            used = min(number, left // each)
            rules.append(Rule(length, rank, each, first, used))
            rank += used * each
            left -= used * each
            last = (*pattern[:-1], (length, pattern[-1][1] + each)) if pattern and pattern[-1][0] == length else (*pattern, (length, each))
            put(room - each * length, first, used, last)
            if used < number:
                put(room, first + used, number - used, pattern)
    for runs in open_runs.values():
        for _, number, pattern in runs:
            full[pattern] += number
    return rules, full


def sizes(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """doc_id and tokens of every document; 0 for a null or empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(vocabulary, folder)
        for b in batches:
            n = [len(encoder.text(_clean(t))) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens long")


def packed(sized: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Every piece of every row of (doc_id, tokens) in a pack of each container.

    A row longer than a capacity is cut into full pieces and a rest; no other is cut.  Columns:
    container, doc_id, piece (from 0), tokens, pack_id (from 0 in each container).  Rows of
    null or no tokens need no room: they come once with a null pack_id.
    """
    spark = sized.sparkSession
    sized = runtime.checkpoint(sized.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
    # the table of containers is small and fixed: each row carries it as a literal
    containers = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("long").alias("capacity")) for c, n in sorted(capacities.items())])
    if not capacities:
        containers = containers.cast("array<struct<container: string, capacity: bigint>>")
    each = sized.select("doc_id", "tokens", F.explode(containers).alias("c")).select("doc_id", "tokens", "c.container", "c.capacity")
    pieces = each.where("tokens > 0")
    whole = F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int")
    pieces = pieces.select("container", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
    pieces = pieces.select("container", "doc_id", "piece", F.least(F.col("tokens") - F.col("piece").cast("long") * F.col("capacity"), "capacity").alias("tokens"))
    # ranks among equal lengths: counts by salt first, then the offsets of the salts
    salts = max(16, sized.count() // ROWS_A_SALT)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = runtime.checkpoint(pieces.groupBy("container", "tokens", "salt").agg(F.count("*").alias("n")))
    histogram = counts.groupBy("container", "tokens").agg(F.sum("n").alias("n")).collect()  # at most the sum of all capacities
    rules: dict[tuple, tuple] = {}
    for container, capacity in capacities.items():
        got, _ = plan({r["tokens"]: r["n"] for r in histogram if r["container"] == container}, capacity)
        rules.update(_by_length(container, got))
    held = spark.sparkContext.broadcast(rules)
    salted = Window.partitionBy("container", "tokens").orderBy("salt")
    offsets = counts.select("container", "tokens", "salt", (F.sum("n").over(salted) - F.col("n")).alias("start"))
    own = Window.partitionBy("container", "tokens", "salt").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("i", F.row_number().over(own)).join(offsets, ["container", "tokens", "salt"])
    ranked = ranked.select("container", "doc_id", "piece", "tokens", (F.col("start") + F.col("i") - 1).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for b in batches:
            out = []
            for container, n, rank in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                ranks, each, packs = known[container, n]
                i = bisect_right(ranks, rank) - 1
                out.append(packs[i] + (rank - ranks[i]) // each[i])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.int64())], names=["container", "doc_id", "piece", "tokens", "pack_id"])

    placed = ranked.mapInArrow(run, "container string, doc_id long, piece int, tokens long, pack_id long")
    empty = each.where("tokens = 0")
    return placed.unionByName(empty.select("container", "doc_id", F.lit(0).alias("piece"), "tokens", F.lit(None).cast("long").alias("pack_id")))


def _by_length(container: str, rules: list[Rule]) -> dict:
    """container and length -> sorted ranks, pieces a pack and first packs of their rules."""
    out: dict = defaultdict(list)
    for r in rules:
        if r.packs:
            out[container, r.length].append((r.rank, r.each, r.pack))
    return {k: tuple(list(c) for c in zip(*sorted(v))) for k, v in out.items()}


#: The most containers; their table is small and fixed.
MOST_CONTAINERS = 1000


def capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The containers of pack_capacity; those without room are left out, and more than MOST_CONTAINERS are an error."""
    table = runtime.table(spark, sf_dir, "pack_capacity").where("container is not null and capacity_tokens > 0")
    rows = table.groupBy("container").agg(F.max("capacity_tokens").alias("n")).limit(MOST_CONTAINERS + 1).collect()
    if len(rows) > MOST_CONTAINERS:
        raise ValueError(f"more than {MOST_CONTAINERS} containers")
    return {r["container"]: r["n"] for r in rows}


def p8_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in a pack of each container of pack_capacity."""
    runtime.tune(spark)
    return packed(sizes(runtime.table(spark, sf_dir, "documents")), capacities(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs, pieces, tokens and the filled share of each container."""
    packs = p8_packs(spark, sf_dir).where("pack_id is not null").groupBy("container", "pack_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    table = runtime.table(spark, sf_dir, "pack_capacity")
    total = packs.groupBy("container").agg(F.count("*").alias("packs"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(table, "container").withColumn("filled", F.col("tokens") / (F.col("packs") * F.col("capacity_tokens"))).drop("capacity_tokens")
