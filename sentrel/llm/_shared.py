"""What the training-data operators have in common: shared storage, hashing, batching of texts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python objects at once; one longer text is still taken whole.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none, as in local tests, a temporary folder is set and removed at exit.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_code.isDefined():
            return set_by_code.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="sentrel-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Tables that the operator at work in this thread has written.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is `written` within, by this thread, is deleted at the end; results that outlast it are written with `keep`."""
    own: list[str] = []
    before = _passing.set(own)
    try:
        yield
    finally:
        _passing.reset(before)
        for path in own:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    own = _passing.get()
    if own is not None and not keep:
        own.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Up to so many ids (about 40 MB in a hash table) are broadcast to select rows of texts; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """`docs` without the rows whose id is in `gone` (one column): broadcast while its counted rows are few, so that no text moves. Rows of a null id stay."""
    gone = written(gone.toDF("__gone").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")


def row_key(*names: str) -> Column:
    """128 bits of a row's values in these columns, nulls too: what a decision on rows is keyed by where ids repeat or are null."""
    parts = [F.coalesce(F.md5(F.col(f"`{n}`").cast("string").cast("binary")), F.lit("null")) for n in names]
    return F.unhex(F.md5(F.concat_ws(",", *parts).cast("binary")))


def without_rows(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """`docs` without the rows whose `key` is in `gone` (one column); as without_ids otherwise."""
    gone = written(gone.toDF("__gone").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, key == F.col("__gone"), "left_anti")


def as_bytes(name: str) -> Column:
    """A text column as its UTF-8 bytes, without copying; other types by their string form."""
    return F.col(f"`{name}`").cast("string").cast("binary")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about `limit` bytes of `column`, so that a task's memory does not follow the batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def give_back() -> None:
    """Return what a task has freed to the system: its worker is kept for later tasks, whose executors share the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to hand Python at most SLICE_BYTES of rows at once (or one longer row): batches of 10,000 whole texts fill JVM and worker alike."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(filter(str.isdigit, conf.get(name, None) or "0")) or 0) != SLICE_BYTES:
        conf.set(name, str(SLICE_BYTES))
    return df


def map_texts(df: DataFrame, text: str, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of `df`. `start()` runs once a task and gives the function of a slice, which returns columns by name."""
    wanted = schema_of(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for part in slices(batch, text, limit):
                out = work(part)
                yield pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in wanted], schema=wanted)
                del out
        del work
        give_back()

    return in_small_batches(df).mapInArrow(run, schema)


def schema_of(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def col_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
