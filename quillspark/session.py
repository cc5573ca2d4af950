"""What operators need to know of the session."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset on a single machine (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
    sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed: it no longer depends on what lost executors held."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def with_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import this package however the driver found it; a cluster gets it with --py-files."""
    here, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))
