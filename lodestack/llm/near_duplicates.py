"""Problem 4: near-duplicate revisions by deletion-variant signatures.

The signature of a text is a vector of minhash symbols of 8 bits; two symbols at one place
agree with the similarity of the texts (and by chance once in 256 times).  The vector is cut into
segments of SYMBOLS symbols, fewer than whole-segment matching would need, because similar
texts have some segment that differs in at most one symbol.  Every segment is indexed under its
one-wildcard variants (one symbol deleted), equal variants bring candidates together, the share of
equal symbols sorts out most of the wrong ones, and an exact comparison decides.

Variants are shuffled once and sorted, and each run of equal ones is paired where it stands.
Longer runs, as of a template that many texts share, are cut into blocks; every pair of blocks is compared
by signatures in a task of its own, so that only agreeing pairs leave it.

The method is stated for bits; bits of a similarity hash of pairs at 60 % differ in a quarter
of the places, at which no segment is both selective and at most one bit off.  Symbols of a
minhash agree in 60 % of the places, at which the same scheme works.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime

#: Length of the runs of code points, least length of a text, and least similarity.
RUN, MIN_LENGTH, MIN_SIMILARITY = 8, 300, 0.6
#: Segments and symbols in each.  A pair at the threshold shares a variant of one segment
#: with probability .6**6 + 6 * .6**5 * .4 = .233, hence of any of 25 with .9987 (a pair at 70 %
#: with .999999); two texts of one language, at 8 %, do so with 25 * 6 * .08**5, one pair in two thousand.
SEGMENTS, SYMBOLS = 25, 6
PLACES = SEGMENTS * SYMBOLS
#: Symbols that are compared, and their share below which candidates are left out: five
#: standard deviations of a pair at the threshold under it.
COMPARED = 60
MIN_AGREEMENT = MIN_SIMILARITY - 5 * (MIN_SIMILARITY * (1 - MIN_SIMILARITY) / COMPARED) ** 0.5
#: Texts with fewer distinct runs have symbols that depend on each other; they are compared at once.
FEW_RUNS = PLACES
#: Classes under one variant that are paired where they stand, and classes of a block of longer runs.
RUN_CLASSES, BLOCK = 64, 2_000

_rng = np.random.default_rng(20)
_WEIGHTS = _rng.integers(1, 2**63, RUN, dtype=np.uint64) | np.uint64(1)
_SALTS = _rng.integers(0, 2**63, (SEGMENTS, SYMBOLS), dtype=np.uint64)
_WIDTH = np.uint64(2**64 // PLACES + 1)
_OWN = np.arange(PLACES, dtype=np.uint64)
_BINS = _OWN * _WIDTH
_UPPER = re.compile("[A-Z]+")


def normal(title: str | None, content: str) -> str:
    """Title and content as they are compared: without white space, A-Z in lower case."""
    t = f"{title or ''}{content}"
    for white in " \t\r\n":
        t = t.replace(white, "")
    return t.lower() if t.isascii() else _UPPER.sub(lambda m: m.group().lower(), t)


def _hashes(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of RUN code points."""
    n = len(points) - RUN + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(RUN):
        h += points[j : j + n] * _WEIGHTS[j]
        h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def grams(text: str) -> np.ndarray:
    """Sorted hashes of the distinct runs of a text; none in one shorter than RUN."""
    return np.unique(_hashes(_points(text)))


def grams_of(texts: list[str]) -> Iterator[np.ndarray]:
    """:func:`grams` of several texts, hashed in one go; runs over their borders are left out."""
    h = _hashes(_points("".join(texts)))
    at = 0
    for t in texts:
        g = h[at : max(at, at + len(t) - RUN + 1)].copy()
        at += len(t)
        g.sort()
        yield g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g


def signature(g: np.ndarray) -> np.ndarray:
    """PLACES minhash symbols of 8 bits; zeros for a text without runs.

    The hash range is cut into PLACES bins, and the least hash of a bin gives its symbol, so
    every run is looked at once.  An empty bin takes the next one's, marked by the distance.
    """
    if not len(g):
        return np.zeros(PLACES, np.uint8)
    at = np.searchsorted(g, _BINS)
    least = g[at % len(g)]
    away = (least // _WIDTH - _OWN) % np.uint64(PLACES)
    h = (least + away * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(56)).astype(np.uint8)


def variants(sigs: np.ndarray) -> np.ndarray:
    """Keys of the one-wildcard variants of every segment, a row a signature."""
    parts = sigs.reshape(len(sigs), SEGMENTS, SYMBOLS).astype(np.uint64)
    out = np.empty((len(sigs), SEGMENTS, SYMBOLS), np.uint64)
    for hole in range(SYMBOLS):
        key = np.broadcast_to(_SALTS[:, hole], (len(sigs), SEGMENTS)).copy()
        for i in range(SYMBOLS):
            if i != hole:
                key = (key ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
        out[:, :, hole] = key
    return out.reshape(len(sigs), -1).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def _signed(texts: DataFrame) -> DataFrame:
    """rev_id, class (a 128-bit hash of the compared text), id (half of it), signature, and whether the text has few runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [normal(t, c) for t, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            classes = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            ids = np.frombuffer(b"".join(c[:8] for c in classes), np.int64)
            sigs, few = [], []
            for i in range(0, len(texts), 64):
                for g in grams_of(texts[i : i + 64]):
                    sigs.append(signature(g).tobytes())
                    few.append(len(g) < FEW_RUNS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classes, pa.binary()), pa.array(ids), pa.array(sigs, pa.binary()), pa.array(few)], names=["rev_id", "class", "id", "sig", "few"])

    return texts.mapInArrow(run, "rev_id string, class binary, id long, sig binary, few boolean")


def _variant_rows(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = variants(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, PLACES))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), keys.shape[1]))], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def _runs(rows: DataFrame, most: int = RUN_CLASSES) -> DataFrame:
    """Candidates (a, b, null), a < b, of the runs of equal keys; of runs of more than ``most`` classes, the members (id, null, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
            starts = np.append(0, ends[:-1])
            sizes = ends - starts
            a, b, hot = [], [], []
            for size in np.unique(sizes[sizes > 1]).tolist():  # all runs of one length at a time
                at = starts[sizes == size]
                if size > most:
                    hot.append((at[:, None] + np.arange(size)).ravel())
                    continue
                i, j = np.triu_indices(size, 1)
                a.append(ids[(at[:, None] + i).ravel()])
                b.append(ids[(at[:, None] + j).ravel()])
            a, b = np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])
            keep = a != b
            a, b = a[keep], b[keep]
            at = np.concatenate([np.empty(0, np.int64), *hot])
            first = np.concatenate([np.minimum(a, b), ids[at]])
            none = len(first) - len(at)
            second = pa.array(np.concatenate([np.maximum(a, b), np.zeros(len(at), np.int64)]), mask=np.arange(len(first)) >= none)
            key = pa.array(np.concatenate([np.zeros(none, np.int64), keys[at]]), mask=np.arange(len(first)) < none)
            return pa.RecordBatch.from_arrays([pa.array(first), second, key], names=["a", "b", "key"])

        def members(ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(np.full(len(ids), hot))], names=["a", "b", "key"])

        keys, ids, hot = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            new_keys, new_ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if hot is not None:  # a long run that began in an earlier batch is handed on as it comes
                at = int(np.searchsorted(new_keys, hot, "right"))
                if at:
                    yield members(new_ids[:at])
                hot = hot if at == len(new_keys) else None
                new_keys, new_ids = new_keys[at:], new_ids[at:]
            keys, ids = np.concatenate([keys, new_keys]), np.concatenate([ids, new_ids])
            at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on
            if at:
                yield emit(keys[:at], ids[:at])
                keys, ids = keys[at:].copy(), ids[at:].copy()
            if len(keys) > most:
                hot = keys[0]
                yield members(ids)
                keys, ids = keys[:0], ids[:0]
        if len(keys):
            yield emit(keys, ids)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long")


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).mean(-1) >= MIN_AGREEMENT


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COMPARED)


def _agreeing(pairs: DataFrame) -> DataFrame:
    """Candidates (a, b, sig_a, sig_b) whose signatures agree often enough, and those without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False) & b.column(3).is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(b.num_rows, bool)
            if len(known):
                at = pa.array(known)
                keep[known] = _agree(_symbols(b.column(2).take(at)), _symbols(b.column(3).take(at)))
            keep = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Agreeing pairs (a, b) of the classes of long runs, rows of (key, id, sig), block by block."""
    sizes = members.groupBy("key").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / block).cast("int")
    rows = members.join(sizes, "key").withColumn("r", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("r")).cast("int"))
    rows = rows.select("key", "id", "sig", "own", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("other"))
    rows = rows.select("key", "id", "sig", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def compare(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        own, known = t.column("own").to_numpy(), t.column("sig").is_valid().to_numpy()
        sigs = np.zeros((len(ids), COMPARED), np.uint8)
        if known.any():
            sigs[known] = _symbols(t.column("sig").combine_chunks().take(pa.array(np.flatnonzero(known))))
        first = t.column("p")[0].as_py()
        left = np.flatnonzero(own == first)
        same = t.column("q")[0].as_py() == first
        right = left if same else np.flatnonzero(own != first)
        a, b = [], []
        for n, i in enumerate(left):  # a row against the others of both blocks
            js = right[n + 1 :] if same else right
            js = js[_agree(sigs[js], sigs[i]) | ~known[js] | ~known[i]]
            a.append(np.minimum(ids[i], ids[js]))
            b.append(np.maximum(ids[i], ids[js]))
        return pa.table({"a": np.concatenate([np.empty(0, np.int64), *a]), "b": np.concatenate([np.empty(0, np.int64), *b])})

    return rows.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long").where("a <> b")


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, title_a, content_a, title_b, content_b) with their exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, np.ndarray] = {}  # a text meets several others in a row

        def of(c: bytes, title: str | None, content: str) -> np.ndarray:
            if c not in memo:
                if len(memo) >= 1000:
                    memo.clear()
                memo[c] = grams(normal(title, content))
            return memo[c]

        for batch in batches:
            a, b, s = [], [], []
            for ca, cb, ta, xa, tb, xb in zip(*(c.to_pylist() for c in batch.columns)):
                v = similarity(of(ca, ta, xa), of(cb, tb, xb))
                if v >= MIN_SIMILARITY:
                    a.append(ca)
                    b.append(cb)
                    s.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a binary, b binary, similarity double")


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions that take part: rev_id, title, content of at least MIN_LENGTH code points."""
    return runtime.table(spark, sf_dir, "resource_revision").select(F.col("resource_revision_id").alias("rev_id"), "title", F.col("content_markdown").alias("content")).where(
        F.col("rev_id").isNotNull() & (F.length("content") >= MIN_LENGTH)
    )


def similar_classes(revs: DataFrame, run_classes: int = RUN_CLASSES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Members (rev_id, class) and pairs (a, b, similarity) of classes of equal texts, a < b.

    Exact copies fall into one class before anything is joined, so a group of copies costs
    as much as one text.  Null titles count as empty; null contents take no part.
    """
    signed = runtime.checkpoint(_signed(revs.select("rev_id", "title", "content")))
    members = signed.select("rev_id", "class").distinct()
    classes = runtime.checkpoint(signed.groupBy("class", "id").agg(F.first("sig").alias("sig"), F.first("few").alias("few"), F.min("rev_id").alias("rev_id")))  # equal texts have equal signatures
    found = runtime.checkpoint(_runs(_variant_rows(classes), run_classes))
    sig = classes.select("id", F.when(~F.col("few"), F.substring("sig", 1, COMPARED)).alias("sig"))
    pairs = found.where("b is not null").select("a", "b").distinct()
    pairs = pairs.join(sig.withColumnsRenamed({"id": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"id": "b", "sig": "sig_b"}), "b")
    pairs = _agreeing(pairs.select("a", "b", "sig_a", "sig_b"))
    long_runs = found.where("b is null").select("key", F.col("a").alias("id"))
    if not long_runs.isEmpty():
        pairs = pairs.unionByName(_in_blocks(long_runs.join(sig, "id"), block))
    pairs = runtime.checkpoint(pairs.distinct())
    # the texts of the classes that are left: one revision each
    left = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    one = classes.select("class", "id", "rev_id").join(left, "id", "left_semi")
    body = revs.join(one, "rev_id").groupBy("class", "id").agg(F.first(F.struct("title", "content")).alias("t")).select("id", "class", "t.title", "t.content")
    x, y = (body.withColumnsRenamed({"id": i, "class": f"c{i}", "title": f"t{i}", "content": f"x{i}"}) for i in "ab")
    joined = pairs.join(x, "a").join(y, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "ta", "xa", "tb", "xb")
    return members, _verified(joined)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of revisions of which at least 60 % of all runs of 8 code points are in both."""
    runtime.tune(spark)
    members, pairs = similar_classes(revisions(spark, sf_dir))
    members = runtime.checkpoint(members)
    x, y = members.withColumnsRenamed({"rev_id": "ra", "class": "a"}), members.withColumnsRenamed({"rev_id": "rb", "class": "b"})
    between = pairs.join(x, "a").join(y, "b").select("ra", "rb")
    within = x.join(y, (F.col("a") == F.col("b")) & (F.col("ra") < F.col("rb"))).select("ra", "rb")
    out = between.unionByName(within)
    return out.select(F.least("ra", "rb").alias("revision_a"), F.greatest("ra", "rb").alias("revision_b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and the least node of its component, by alternating large and small stars.

    ``edges`` holds each undirected edge once or more; self-loops don't matter.  Each round is
    checkpointed; rounds grow with the logarithm of the largest component.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    e = runtime.checkpoint(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        new = runtime.checkpoint(small.select("s.u", "s.v").where(F.col("u") != F.col("v")).distinct())
        changed = new.join(e, ["u", "v"], "left_anti").limit(1).count() + e.join(new, ["u", "v"], "left_anti").limit(1).count()
        e = new
        if not changed:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a revision that takes part: its class of equal texts, its group, its links.

    ``class_id`` and ``group_id`` are the least revision in them; ``links`` is the number of
    other classes that its class is similar to.  Copies are not expanded into pairs.
    """
    runtime.tune(spark)
    members, pairs = similar_classes(revisions(spark, sf_dir))
    members, pairs = runtime.checkpoint(members), runtime.checkpoint(pairs)
    names = members.groupBy("class").agg(F.min("rev_id").alias("class_id"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    roots = components(pairs).withColumnsRenamed({"node": "class"})
    info = names.join(roots, "class", "left").join(links, "class", "left")
    info = info.select("class", "class_id", F.coalesce("root", "class").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    groups = info.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return members.join(info, "class").join(groups, "root").select(F.col("rev_id").alias("resource_revision_id"), "class_id", "group_id", "links")
