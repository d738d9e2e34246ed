"""What the driver and all executors share: folders, and this package's code."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from its install path (or from --py-files, where that path is absent)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: spark.checkpoint.dir; a temporary one only in local mode with none set."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="strandwise-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
