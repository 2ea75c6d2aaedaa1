"""A folder that driver and executors share, for what jobs write between their steps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where a local session names none, a temporary folder is set and removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_code.isDefined():
        return set_by_code.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="sentrel-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{local}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """`df` written once to the shared folder and read back, for what several steps read: it is computed once, and each step reads its columns only. Its folder is added to `paths`, for who deletes it."""
    path = scratch_path(df.sparkSession, label)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
