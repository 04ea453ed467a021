"""What runs take on: reuse of results, sizes of plans, limits, chunks, and when they are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import row_numbers

CACHE_KEY = ["resource_revision_id", "operation", "backend", "model", "prompt_version", "schema_version"]


def reusable(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests (CACHE_KEY, fingerprint, legacy_fingerprint) with the result of a completed run, if there is one.

    ``runs`` holds CACHE_KEY, fingerprint, fingerprint_version, status, finished_at, run_id and result.
    The present fingerprint counts before the legacy one; of several runs the newest.  ``reused`` is
    ``current``, ``legacy`` or null.
    """
    done = runs.where((F.col("status") == "completed") & F.col("result").isNotNull())
    newest = done.groupBy(*CACHE_KEY, "fingerprint", "fingerprint_version").agg(F.max_by(F.struct("run_id", "result"), F.struct("finished_at", "run_id")).alias("r"))
    current = newest.where("fingerprint_version = 2").select(*CACHE_KEY, "fingerprint", F.col("r").alias("__2"))
    legacy = newest.where("fingerprint_version = 1").select(*CACHE_KEY, F.col("fingerprint").alias("legacy_fingerprint"), F.col("r").alias("__1"))
    both = requests.join(current, [*CACHE_KEY, "fingerprint"], "left").join(legacy, [*CACHE_KEY, "legacy_fingerprint"], "left")
    reused = F.when(F.col("__2").isNotNull(), "current").when(F.col("__1").isNotNull(), "legacy")
    return both.select(*requests.columns, F.coalesce("__2.run_id", "__1.run_id").alias("run_id"), F.coalesce("__2.result", "__1.result").alias("result"), reused.alias("reused"))


def promoted(runs: DataFrame, found: DataFrame) -> DataFrame:
    """Runs in which those that were found by a legacy fingerprint have the present one."""
    new = found.where("reused = 'legacy'").groupBy("run_id").agg(F.max("fingerprint").alias("__f"))
    take = F.col("__f").isNotNull()
    out = {"fingerprint": F.coalesce("__f", "fingerprint"), "fingerprint_version": F.when(take, 2).otherwise(F.col("fingerprint_version"))}
    return runs.join(new, "run_id", "left").select(*[out[c].alias(c) if c in out else F.col(c) for c in runs.columns])


def one_item_a_resource(resources: DataFrame, items: DataFrame) -> DataFrame:
    """Resources (resource_id, ...) with the metadata of the first of their items (resource_id, source_id, metadata) by id."""
    first = items.groupBy("resource_id").agg(F.min_by("metadata", "source_id").alias("metadata"), F.min("source_id").alias("source_id"))
    return resources.join(first, "resource_id")


def plan_totals(candidates: DataFrame, most_output: int = 800) -> DataFrame:
    """Requests that are new and that are reused, tokens in and expected out, of candidates (reused, tokens_in, ratio)."""
    new = F.col("reused").isNull()
    out = F.least(F.bround(F.col("tokens_in") * F.col("ratio")), F.lit(float(most_output))).cast("long")
    return candidates.agg(
        F.count_if(new).alias("new_requests"), F.count_if(~new).alias("reusable"), F.coalesce(F.sum(F.when(new, F.col("tokens_in"))), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(F.when(new, out)), F.lit(0)).alias("tokens_out")
    )


def up_to_new(rows: DataFrame, order: list[str], is_new: Column, n: int) -> DataFrame:
    """Rows in an order (ascending, unique) up to and with the n-th that is new; all of them if there are fewer.

    Only n rows go to one task; the others are compared with the last of them.
    """
    if n <= 0:
        return rows.limit(0)
    firsts = rows.where(is_new).select(*order).orderBy(*order).limit(n)
    last = firsts.agg(F.max(F.struct(*order)).alias("last"), F.count("*").alias("c")).first()  # one row
    if last["c"] < n:
        return rows
    return rows.where(F.struct(*order) <= F.struct(*[F.lit(last["last"][c]).alias(c) for c in order]))


def chunks(rows: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """Adds ``wave`` and ``part``: a chunk is a part of a wave, holds at most ``size`` rows and no key twice.

    The k-th row of a key comes in wave k, so rows that repeat a key wait for a later chunk; waves are
    cut by size in order.  Null and empty keys repeat nothing.
    """
    blank = F.coalesce(key, F.lit("")) == ""
    keyed = row_numbers(rows.where(~blank), [key], order, "wave").unionByName(rows.where(blank).withColumn("wave", F.lit(1).cast("long")))
    return row_numbers(keyed, ["wave"], order, "__i").withColumn("part", F.floor((F.col("__i") - 1) / size).cast("long")).drop("__i")


def due_by_hours(targets: DataFrame, runs: DataFrame, key: str, now: Column, hours: int = 168) -> DataFrame:
    """Targets (key, and hours if they have their own) whose last completed run (key, finished_at, status) is so long ago, or that have none."""
    last = runs.where("status = 'completed'").groupBy(key).agg(F.max("finished_at").alias("__last"))
    own = F.coalesce(F.col("hours"), F.lit(hours)) if "hours" in targets.columns else F.lit(hours)
    age = (F.unix_micros(now) - F.unix_micros(F.col("__last").cast("timestamp"))) / F.lit(3_600_000_000.0)
    return targets.join(last, key, "left").where(F.col("__last").isNull() | (age >= own)).select(*targets.columns)


def latest_run(runs: DataFrame, providers: str | None = None, completed: bool = False) -> DataFrame:
    """The newest run by started_at and run_id, of those that have a provider in their list."""
    rows = runs.where(F.array_contains("providers", providers)) if providers else runs
    rows = rows.where("status = 'completed'") if completed else rows
    return rows.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)
