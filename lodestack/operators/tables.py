"""Tables on a shared file system that change at once, or not at all.

A table is a folder with data folders and numbered manifests.  A manifest names the data folders
of one version and, for streams, the last batch of each writer in it.  Data are written first, to folders of
their own; then the next manifest is put in place by a rename that fails if it is there already.
A reader takes the manifest with the highest number, so a crash at any point leaves the version
before, and of two writers one fails.  Nothing is ever deleted that the last two manifests name.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table that is merged by key; a batch rewrites those that it touches.
BUCKETS = 64
_NAME = re.compile(r"^(\d{12})\.json$")


class NoTableError(FileNotFoundError):
    """There is no version of a table."""


class ConflictError(RuntimeError):
    """Another writer has put the next version in place."""


class _Files:
    """The files of one table, through the file system that Spark reads it by."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.root = spark._jvm, path
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        folder = self.at("_versions")
        found = [_NAME.match(s.getPath().getName()) for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(m[1]) for m in found if m)

    def load(self, number: int) -> dict:
        stream = self.fs.open(self.at(f"_versions/{number:012}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, number: int, manifest: dict) -> None:
        aside, target = self.at(f"_versions/.{uuid.uuid4().hex}"), self.at(f"_versions/{number:012}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if self.fs.exists(target) or not self.fs.rename(aside, target):
            self.fs.delete(aside, False)
            raise ConflictError(f"version {number} of {self.root} is there already")

    def forget(self, numbers: list[int]) -> None:
        """Deletes versions but the last two, and data that only they name."""
        kept = {f for n in numbers[-2:] for f in self.load(n)["folders"].values()}
        for n in numbers[:-2]:
            for f in set(self.load(n)["folders"].values()) - kept:
                self.fs.delete(self.at(f), True)
            self.fs.delete(self.at(f"_versions/{n:012}.json"), False)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the current version with its ``number``; None if there is none."""
    files = _Files(spark, path)
    numbers = files.numbers()
    return files.load(numbers[-1]) | {"number": numbers[-1]} if numbers else None


def _commit(spark: SparkSession, path: str, before: dict | None, new: dict) -> None:
    files = _Files(spark, path)
    files.put(before["number"] + 1 if before else 0, new)
    files.forget(files.numbers())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version; an error if there is none."""
    m = manifest(spark, path)
    if m is None:
        raise NoTableError(path)
    return spark.read.schema(m["schema"]).parquet(*[f"{path}/{f}" for f in m["folders"].values()]) if m["folders"] else spark.createDataFrame([], m["schema"])


def write_table(df: DataFrame, path: str, note: str = "") -> None:
    """Replaces a table by a new version."""
    spark = df.sparkSession
    before = manifest(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    _commit(spark, path, before, {"folders": {"all": folder}, "schema": _ddl(df), "batches": before["batches"] if before else {}, "note": note})


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def merge_batch(batch: DataFrame, path: str, keys: list[str], compare: list[str], writer: str, number: int, buckets: int = BUCKETS) -> dict[str, int] | None:
    """Merges batch ``number`` of a writer, one row a key, and returns how many rows each action has.

    Only the buckets of keys that the batch touches are read and written.  A batch that is in
    the table already is left alone and gives None.  A table that is missing counts as empty for
    the first batch only; later it is an error.
    """
    from .merge import upsert

    spark = batch.sparkSession
    before = manifest(spark, path)
    if before is None and number > 0:
        raise NoTableError(f"{path} is gone, though batches before {number} of {writer} were merged")
    if before and before["batches"].get(writer, -1) >= number:
        return None
    buckets = before.get("buckets", buckets) if before else buckets
    if before and "buckets" not in before:
        raise ValueError(f"{path} is not a table of buckets")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
    folders = dict(before["folders"]) if before else {}
    names = [f"{path}/{folders[str(b)]}" for b in touched if str(b) in folders]
    target = spark.read.schema(before["schema"]).parquet(*names) if names else spark.createDataFrame([], before["schema"] if before else batch.schema)
    seen = Observation(f"merge-{uuid.uuid4().hex}")
    kinds = ("insert", "update", "unchanged", "keep")
    merged = upsert(target, batch.select(*target.columns), keys, compare).observe(seen, *[F.count_if(F.col("action") == k).alias(k) for k in kinds])
    folder = f"data-{uuid.uuid4().hex}"
    merged.drop("action").withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/{folder}")
    counts = {k: n for k, n in seen.get.items() if n}
    if counts.get("insert") or counts.get("update"):
        folders |= {str(b): f"{folder}/__bucket={b}" for b in touched}
    else:
        files = _Files(spark, path)
        files.fs.delete(files.at(folder), True)
    done = (before["batches"] if before else {}) | {writer: number}
    _commit(spark, path, before, {"folders": folders, "schema": before["schema"] if before else _ddl(target), "batches": done, "buckets": buckets, "note": ""})
    return counts
