"""Tables that are updated by key: rows lie in buckets by the hash of their key, and an update rewrites the buckets that it touches.

A version of the touched buckets is written aside; one small commit then makes it the current one. Commits are
numbered, and of two writers that start from the same state one wins; the other begins again from the new state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import commits
from .tables import upsert_by_key

#: Keys of so many buckets; a large table takes as many as make a bucket some hundred megabytes.
BUCKETS = 256
TRIES = 10


def state_of(spark: SparkSession, path: str) -> tuple[int, int, dict[int, str]]:
    """(number of the last commit, number of buckets, folder of each bucket) of the table at `path`; 0 commits where there is none."""
    if not commits.exists(spark, f"{path}/{commits.COMMITS}"):
        return 0, 0, {}
    found = sorted((json.loads(r.value) for r in spark.read.text(f"{path}/{commits.COMMITS}/*.json", wholetext=True).collect()), key=lambda c: c["number"])
    folders: dict[int, str] = {}
    for c in found:
        folders.update({int(b): f for b, f in c["folders"].items()})
    return found[-1]["number"], found[-1]["buckets"], folders


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def read_merged(spark: SparkSession, path: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
    """The current rows of the table at `path`, or of some of its buckets."""
    folders = state_of(spark, path)[2]
    own = [f"{path}/{f}" for b, f in sorted(folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(ddl).parquet(*own).select(*StructType.fromDDL(ddl).fieldNames()) if own else spark.createDataFrame([], ddl)


def merge_by_key(updates: DataFrame, path: str, ddl: str, key: str, provided: list[str], order: str, supplied: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Apply `updates` to the table at `path` as upsert_by_key does, and commit it. Returns the buckets that were rewritten; the others' files stay as they are.

    `buckets` counts when the table is begun. The table is begun by updates too: all of its rows are then new keys, and
    columns that aren't provided are null. No updates, no commit.
    """
    spark = updates.sparkSession
    for _ in range(TRIES):
        number, held, folders = state_of(spark, path)
        count = held or buckets
        touched = sorted(r.b for r in updates.select(bucket_of(key, count).alias("b")).distinct().collect())
        if not touched:
            return []
        version = f"version={uuid.uuid4().hex}"
        merged = upsert_by_key(read_merged(spark, path, ddl, touched), updates, key, provided, order, supplied)
        merged.repartition(bucket_of(key, count)).withColumn("bucket", bucket_of(key, count)).write.partitionBy("bucket").parquet(f"{path}/{version}")
        commit = {"number": number + 1, "buckets": count, "folders": {b: f"{version}/bucket={b}" for b in touched}}
        if commits.put_once(spark, f"{path}/{commits.COMMITS}/{number + 1:012}.json", json.dumps(commit)):
            return touched
        commits.remove(spark, f"{path}/{version}")
    raise RuntimeError(f"{path}: other writers were first {TRIES} times")
