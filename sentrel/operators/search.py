"""Substring search over indicators by a stored index of trigrams.

The index has two tables, each in PARTS folders by hash: postings (gram, key), sorted by gram, and the indicators by key. A
search reads the folders of its grams, keeps the keys that all of them lead to, reads these keys' folders, and
verifies each value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .enrich import grams
from .feeds import search_ioc

GRAM, PARTS = 3, 64


def part_of(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(parts)).cast("int")


def index_iocs(iocs: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write the index of `iocs` (with ioc_value) under `path`. Null values are left out, as no search finds them; rows that are equal are one key."""
    keyed = iocs.where("ioc_value is not null").withColumn("__key", F.xxhash64(*[F.col(c).cast("string") for c in iocs.columns]))
    postings = keyed.select("__key", F.explode(grams(F.lower("ioc_value"), (GRAM,))).alias("gram")).distinct()
    for df, name, by in ((postings, "postings", "gram"), (keyed, "values", "__key")):
        df.withColumn("part", part_of(by, parts)).repartition("part").sortWithinPartitions("part", by).write.partitionBy("part").parquet(f"{path}/{name}")


def pieces(value: str) -> list[str]:
    """The literal parts of a LIKE pattern, lower case: what lies between wildcards; a backslash takes the next character as it is."""
    out, now = [], ""
    for m in re.finditer(r"\\(.)|(.)", value.lower(), re.DOTALL):
        if m[2] in ("%", "_"):
            out.append(now)
            now = ""
        else:
            now += m[1] if m[1] is not None else m[2]
    return [p for p in [*out, now] if p]


def find_iocs(spark: SparkSession, path: str, value: str, parts: int = PARTS) -> DataFrame:
    """What search_ioc finds for `value`, from the index under `path`. A pattern without three characters in a row reads all values."""
    wanted = sorted({p[i : i + GRAM] for p in pieces(value) for i in range(len(p) - GRAM + 1)})
    rows = spark.read.parquet(f"{path}/values")
    if wanted:
        # the part of each gram and key is computed by Spark, so that it is the one that was written
        folders = [r.p for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(part_of("gram", parts).alias("p")).distinct().collect()]
        found = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(folders) & F.col("gram").isin(wanted))
        keys = found.groupBy("__key").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("__key", part_of("__key", parts).alias("part"))
        near = [r.part for r in keys.select("part").distinct().collect()]
        rows = rows.where(F.col("part").isin(near)).join(keys.select("__key"), "__key", "left_semi") if near else rows.where("false")
    return search_ioc(rows, value).drop("__key", "part")
