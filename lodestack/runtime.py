"""Session helpers shared by all operators: reading tables, cutting lineage, shipping code."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch.  Texts may be long: a batch of the default 10,000 may not fit.
ARROW_ROWS = 1_000
#: Bytes of one Arrow batch, about.
ARROW_BYTES = 4 << 20
_PACKAGE = Path(__file__).resolve().parent


def tune(spark: SparkSession) -> SparkSession:
    """Settings that every operator counts on; cluster-wide sizes stay as they are."""
    wanted = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES),
    }
    for key, value in wanted.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to executors that don't find it by themselves."""
    sc = spark.sparkContext
    root = str(_PACKAGE.parent)
    if sc.master.startswith("local[") or sc.master == "local" or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if any(Path(p).name == "lodestack.zip" for p in getattr(sc, "_python_includes", [])):
        return
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if shared.startswith("/"):
        folder = Path(shared) / f"code-{sc.applicationId}"
    elif sc.master.startswith("local"):  # all executors are on this machine
        folder = Path(tempfile.mkdtemp())
    else:
        raise RuntimeError("the package is on no executor: name a shared folder in spark.checkpoint.dir, or put the package into PYTHONPATH")
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / "lodestack.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the archive; column pruning and pushed filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint, which outlives the loss of executors.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``; where that is
    unset and all executors are on this machine, as in tests, one of our own is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("name a shared folder in spark.checkpoint.dir: checkpoints on single machines are lost with them")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestack-checkpoints-"))
    return df.checkpoint(eager=True)
