"""Session helpers: lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``.

    Where none is named, a temporary folder is used only if the session is a single-JVM local one;
    on a cluster that would lie on one machine, so an error is raised instead.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if named:
        sc.setCheckpointDir(named)
        return
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder (eager)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: Spark serves them a zip of it, unless PYTHONPATH names its folder already."""
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_palimpsest_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._palimpsest_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores: a small file of one row group would else keep one core busy. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
