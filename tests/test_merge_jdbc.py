"""Updates that rewrite only the buckets they touch, and reads from a database in splits."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from sentrel.sources import commits, merge, tables

DDL = "k long, name string, n int"
UPDATES = f"{DDL}, o int, given array<string>"
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*.parquet")}


def test_updates_rewrite_the_buckets_they_touch(spark, tmp_path):
    path = f"{tmp_path}/t"
    first = spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("name"), F.lit(1).alias("n"), F.lit(0).alias("o"))
    assert len(merge.merge_by_key(first, path, DDL, "k", ["name", "n"], "o", buckets=64)) == 64
    before = files(tmp_path / "t")
    change = spark.createDataFrame([(5, "b", None, 1, ["name"]), (5, "c", 7, 2, ["name"]), (9999, None, 3, 1, ["n"])], UPDATES)
    touched = merge.merge_by_key(change, path, DDL, "k", ["name", "n"], "o", "given")
    assert 1 <= len(touched) <= 2
    added = set(files(tmp_path / "t")) - set(before)
    assert len(added) <= 2 and before.items() <= files(tmp_path / "t").items()
    rows = {r.k: (r.name, r.n) for r in merge.read_merged(spark, path, DDL).collect()}
    assert len(rows) == 2001 and rows[5] == ("c", 1) and rows[9999] == (None, 3) and rows[6] == ("a", 1)
    assert {r.k for r in merge.read_merged(spark, path, DDL, touched).collect()} >= {5, 9999}
    assert merge.merge_by_key(change.limit(0), path, DDL, "k", ["name"], "o") == []
    assert merge.read_merged(spark, f"{tmp_path}/none", DDL).count() == 0


def test_merges_give_what_upserts_give(spark, tmp_path):
    draw = random.Random(6)
    path, target = f"{tmp_path}/t", spark.createDataFrame([], DDL)
    for _ in range(4):
        rows = [(draw.choice([*range(12), None]), draw.choice(["x", "y", None]), draw.choice([1, 2, None]), draw.randrange(3), draw.sample(["name", "n"], draw.randrange(3))) for _ in range(9)]
        updates = spark.createDataFrame(rows, UPDATES)
        target = spark.createDataFrame(tables.upsert_by_key(target, updates, "k", ["name", "n"], "o", "given").collect(), DDL)
        merge.merge_by_key(updates, path, DDL, "k", ["name", "n"], "o", "given", buckets=4)
        assert sorted(map(str, merge.read_merged(spark, path, DDL).where("k is not null").collect())) == sorted(map(str, target.where("k is not null").collect()))


def test_of_two_writers_the_second_begins_again(spark, tmp_path, monkeypatch):
    path, row = f"{tmp_path}/t", lambda k, name: spark.createDataFrame([(k, name, 1, 1)], f"{DDL}, o int")
    merge.merge_by_key(row(1, "a"), path, DDL, "k", ["name", "n"], "o", buckets=1)
    put, met = commits.put_once, []

    def other_first(*args):
        if not met:
            met.append(True)
            merge.merge_by_key(row(2, "b"), path, DDL, "k", ["name", "n"], "o")
        return put(*args)

    monkeypatch.setattr(commits, "put_once", other_first)
    merge.merge_by_key(row(1, "c"), path, DDL, "k", ["name"], "o")
    assert {(r.k, r.name) for r in merge.read_merged(spark, path, DDL).collect()} == {(1, "c"), (2, "b")}
    assert len(list((tmp_path / "t").glob("version=*"))) == 3  # what lost is gone


@pytest.fixture
def database(spark):
    where = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": DERBY}
    services = '[{"port":22,"service":"ssh","product":"openssh","version":"8"}]'
    rows = [(k if k else None, f"asset-{k}", f"h{k}", "high" if k % 4 == 0 else "low", services if k % 2 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)) for k in range(200)]
    df = spark.createDataFrame(rows, "ID long, assetId string, HOSTNAME string, CRITICALITY string, services string, createdAt timestamp")
    df.write.format("jdbc").options(**where, dbtable="ASSETS", createTableColumnTypes="CRITICALITY varchar(20)").mode("append").save()
    return where


def test_a_database_is_read_in_splits(spark, database):
    rows = tables.read_table(spark, "assets", dbtable="ASSETS", partitionColumn="ID", numPartitions=5, where="CRITICALITY = 'high'", **database)
    assert rows.rdd.getNumPartitions() == 5
    scan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(CRITICALITY), *EqualTo(CRITICALITY,high)]" in scan
    assert "OPERATING" not in scan
    got = {r.asset_id: r for r in rows.collect()}
    assert len(got) == 50 and got["asset-0"].id is None and got["asset-4"].services is None and got["asset-4"].operating_system is None
    every = tables.read_table(spark, "assets", dbtable="ASSETS", partitionColumn="\"createdAt\"", numPartitions=3, **database)
    sizes = every.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert every.count() == 200 and len(sizes) == 3 and max(r["count"] for r in sizes) < 80
    assert every.where("id = 3").first().services[0].port == 22


def test_an_empty_table_and_one_without_splits(spark, database):
    rows = tables.read_table(spark, "assets", dbtable="(select * from ASSETS where ID < 0) t", partitionColumn="ID", **database)
    assert rows.count() == 0
    assert tables.read_table(spark, "assets", dbtable="ASSETS", **database).rdd.getNumPartitions() == 1
