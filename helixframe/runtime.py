"""Sending this package to the Python workers, and checkpoints that outlive an executor."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Add this package as a Python file of the application, once, unless PYTHONPATH already leads the workers to it."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    here = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if context.applicationId in _sent or str(package.parent) in here:
        return
    _sent.add(context.applicationId)
    to = os.path.join(tempfile.mkdtemp(prefix="helixframe-"), "helixframe_package.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(to)


def checkpoint_folder(spark: SparkSession) -> str:
    """Where checkpoints go: the folder that is set, else one beside the tables of the warehouse, which executors share as well.

    Only a session of one machine, as in tests, gets a temporary folder of its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        local = spark.sparkContext.master.startswith("local")
        known = tempfile.mkdtemp(prefix="helixframe-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_helixframe_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


#: Spark removes the shuffle files of a plan that is made while this is set, once the plan has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the folder for checkpoints, and cut its lineage; what it has shuffled leaves the disk then."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        mine = df.select("*")  # a plan of its own, whose shuffles nothing else reads
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return mine.checkpoint(eager=True)
