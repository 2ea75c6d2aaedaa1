"""Tables whose writes are whole or not at all, whoever writes: batches, streams, and their retries, side by side.

A write puts the files of all its tables into folders of its own (`<table>/run=<attempt>/kept=<true or false>/...`), and one small
file under `_commits` then makes them part of the tables, all at once. Readers look at the commits and see only what
they name. A run that is committed is not written again, so a retried batch writes once; runs of different streams
never meet. Commits also hold counts that add up over runs, by the values of closed columns, so that a poll reads
counts instead of rows.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import ENUMS

COMMITS, REPLACED = "_commits", "_commits/replaced"


@dataclass
class Commit:
    """What one write added: for each table its folder, rows, refused rows, first and last time, and counts by closed columns."""

    run: str
    tables: dict[str, dict] = field(default_factory=dict)
    #: Runs whose rows this one holds instead of them.
    replaces: list[str] = field(default_factory=list)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = file_system(spark, path)
    return fs.exists(own)


def remove(spark: SparkSession, path: str) -> None:
    fs, own = file_system(spark, path)
    fs.delete(own, True)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file of this text at `path`, there as a whole or not at all; False if there was one already."""
    fs, own = file_system(spark, path)
    if fs.exists(own):
        return False
    draft = spark._jvm.org.apache.hadoop.fs.Path(own.getParent(), f".{own.getName()}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri() if own.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, own, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:  # noqa: BLE001 - py4j wraps Java's FileAlreadyExistsException
        fs.delete(draft, False)
        if not fs.exists(own):
            raise error
        return False
    return True


def committed(spark: SparkSession, path: str) -> list[Commit]:
    """The commits under `path` in the order of their runs, without those that another one replaces; and none of a folder that has no commits."""
    if not exists(spark, f"{path}/{COMMITS}"):
        return []
    found = {c.run: c for c in (Commit(**json.loads(r.value)) for r in spark.read.text(f"{path}/{COMMITS}/*.json", wholetext=True).collect())}
    gone = {r for c in found.values() for r in c.replaces}
    return [found[r] for r in sorted(found) if r not in gone]


def commit_path(path: str, run: str, folder: str = COMMITS) -> str:
    return f"{path}/{folder}/{quote(run, safe='')}.json"


def is_committed(spark: SparkSession, path: str, run: str) -> bool:
    """Whether this run has been written, also where another one has replaced it since: its commit stays."""
    return exists(spark, commit_path(path, run)) or exists(spark, commit_path(path, run, REPLACED))


def table_folder(path: str, table: str, single: bool) -> str:
    return path if single else f"{path}/{table}"


def write_run(outputs: dict[str, DataFrame], path: str, times: dict[str, str], run: str | None = None, single: bool = False, replaces: list[str] | None = None) -> bool:
    """Write the rows of all tables, by day where `times` names a table's time, and commit them as one run; False if that run is there already.

    The frames have a column `reject_reason`, which is null in what the table takes. Each is evaluated once. With
    `single` the one table lies in `path` itself.
    """
    spark = next(iter(outputs.values())).sparkSession
    run = run or f"run-{uuid.uuid4().hex}"
    if is_committed(spark, path, run):
        return False
    commit, attempt = Commit(run, replaces=replaces or []), uuid.uuid4().hex
    for table, df in outputs.items():
        folder, seen = f"{table_folder(path, table, single)}/run={attempt}", Observation()
        kept, day = F.col("reject_reason").isNull(), times.get(table)
        sums = {f"{c}={v}": F.count_if(kept & (F.col(c) == v)) for (t, c), values in ENUMS.items() if t == table for v in values}
        spans = [of(F.when(kept, F.col(day))).cast("string").alias(name) for of, name in ((F.min, "first"), (F.max, "last"))] if day else []
        rows = df.observe(seen, F.count_if(kept).alias("rows"), F.count_if(~kept).alias("rejected"), *spans, *[s.alias(n) for n, s in sums.items()]).withColumn("kept", kept)
        rows = rows.withColumn("event_date", F.to_date(day)) if day else rows
        rows.write.partitionBy("kept", *["event_date"] * bool(day)).parquet(folder)
        got = seen.get
        commit.tables[table] = {"folder": f"run={attempt}", **{k: got[k] for k in ("rows", "rejected", "first", "last") if k in got}, "counts": {k: got[k] for k in sums if got[k]}}
    if put_once(spark, commit_path(path, run), json.dumps(commit.__dict__)):
        return True
    for table in outputs:
        remove(spark, f"{table_folder(path, table, single)}/run={attempt}")
    return False


def read_runs(spark: SparkSession, table: str, path: str, ddl: str, rejected: bool = False, first: str | None = None, last: str | None = None, single: bool = False) -> DataFrame:
    """The committed rows of a table by the columns of `ddl` (missing ones are null; `event_date` and `run` may be among them), or those that it refused.

    `first` and `last` leave out the runs that have no row in that span; their rows are not cut to it.
    """
    folders = []
    for c in committed(spark, path):
        own = c.tables.get(table)
        if own and own["rejected" if rejected else "rows"] and (first is None or own.get("last") is None or own["last"] >= first) and (last is None or own.get("first") is None or own["first"] <= last):
            folders.append(f"{table_folder(path, table, single)}/{own['folder']}/kept={str(not rejected).lower()}")
    if not folders:
        return spark.createDataFrame([], ddl)
    rows = spark.read.schema(ddl).option("basePath", table_folder(path, table, single)).parquet(*folders)
    return rows.select(*StructType.fromDDL(ddl).fieldNames())


def counts(spark: SparkSession, path: str) -> dict[str, Counter]:
    """Of each table the committed rows (key "") and those by the values of its closed columns ("severity=high"), from commits alone."""
    out: dict[str, Counter] = {}
    for c in committed(spark, path):
        for table, own in c.tables.items():
            out.setdefault(table, Counter()).update({"": own["rows"], **own["counts"]})
    return out


def count_changes(changes: DataFrame, path: str, table: str, column: str, run: str | None = None) -> bool:
    """Commit that rows of a table went from the value `before` to `after` of a closed column, a row each: the counts follow, the stored rows stay. False if the run is there already."""
    spark = changes.sparkSession
    run = run or f"changes-{uuid.uuid4().hex}"
    if is_committed(spark, path, run):
        return False
    moved: Counter = Counter()
    for r in changes.where(F.col("before").isin(*ENUMS[table, column]) & F.col("after").isin(*ENUMS[table, column])).groupBy("before", "after").count().collect():
        moved.update({f"{column}={r.before}": -r["count"]})
        moved.update({f"{column}={r.after}": r["count"]})
    return put_once(spark, commit_path(path, run), json.dumps(Commit(run, {table: {"folder": "", "rows": 0, "rejected": 0, "counts": dict(moved)}}).__dict__))


def compact(spark: SparkSession, path: str, ddl: dict[str, str], times: dict[str, str]) -> bool:
    """Rewrite all committed runs as one, with fewer and larger files; readers see either the runs or the new one. False if there are fewer than two.

    `ddl` has the columns of each table. Folders that no commit names any more are left for `vacuum`.
    """
    old = [c for c in committed(spark, path) if any(own["folder"] for own in c.tables.values())]
    if len(old) < 2:
        return False
    outputs = {}
    for table in sorted({t for c in old for t in c.tables}):
        rows = read_runs(spark, table, path, ddl[table]).withColumn("reject_reason", F.lit(None).cast("string"))
        refused = read_runs(spark, table, path, f"{ddl[table]}, reject_reason string", rejected=True)
        both = rows.unionByName(refused)
        outputs[table] = both.repartition(F.to_date(times[table]), F.pmod(F.xxhash64(*both.columns[:1]), F.lit(8))) if table in times else both
    return write_run(outputs, path, times, f"compact-{uuid.uuid4().hex}", replaces=sorted({r for c in old for r in (c.run, *c.replaces)}))


def vacuum(spark: SparkSession, path: str, tables: list[str], single: bool = False) -> list[str]:
    """Delete the folders of runs that no commit names: of writes that failed, and of runs that were replaced, whose commits are put away. Run it while nobody writes or reads old runs. The folders' names."""
    for run in sorted({r for c in committed(spark, path) for r in c.replaces}):
        fs, old = file_system(spark, commit_path(path, run))
        if fs.exists(old):
            new = spark._jvm.org.apache.hadoop.fs.Path(commit_path(path, run, REPLACED))
            fs.mkdirs(new.getParent())
            fs.rename(old, new)
    named = {own["folder"] for c in committed(spark, path) for own in c.tables.values()}
    gone = []
    for table in tables:
        fs, folder = file_system(spark, table_folder(path, table, single))
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            name = status.getPath().getName()
            if name.startswith("run=") and name not in named:
                fs.delete(status.getPath(), True)
                gone.append(name)
    return sorted(gone)
