"""WARC archives and a two-level capture index.

A task writes its pages as gzip members, one a record, into files of its own through Arrow's file systems (local,
HDFS, object stores), and hands on where each record lies: file, offset, length. What the tasks hand on is written by
Spark, which keeps one attempt of each task; files that no kept attempt names are removed. The index sorts
(reversed-host URL key, page) by range into compressed blocks of lines; a sparse directory keeps each block's first
and last key. Look-ups search the directory by bisection, read the blocks that they need, bisect those, and read each
record by its own range of bytes: no archive is read whole.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, give_back, in_small_batches, scratch_path, slices, written

LINES = 500
#: From this payload size on, equal payloads are stored once.
LEAST_BYTES = 1000
#: A file is closed at this size; a record is never parted.
FILE_BYTES = 1 << 30
#: Records whose ranges lie this close together are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Directory entries that are broadcast; a larger directory is searched where its own sorted parts lie.
BROADCAST_BLOCKS = 200_000
#: Fixed by WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = pa.schema([("key", pa.string()), ("page", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE_DDL = "key string, page string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query in lower-case host form; a port stays with the host, user names and fragments go."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "://" in url else f"//{url}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(host.split("."))) if host else ""
    return f"{labels}{f':{port}' if port else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


def record_id(page_id: object, digest: str) -> str:
    """The same page with the same payload gives the same id, so a revisit can name the record that it refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def header(**fields: object) -> bytes:
    lines = ["WARC/1.1", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


def located(path: str) -> str:
    """The path as a URI that Arrow opens."""
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def one_line(url: str) -> str:
    """A header value holds no line ends; they are percent-coded (and read back)."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def whole_url(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page: dict, date: str) -> bytes:
    """A gzip member with all fields that WARC requires: type, id, date and length, and for a revisit its profile and what it refers to."""
    revisit = page["record_type"] == "revisit"
    payload = b"" if revisit else page["payload"]
    head = header(
        WARC_Type=page["record_type"],
        WARC_Record_ID=record_id(page["page_id"], page["digest"]),
        WARC_Date=date,
        WARC_Target_URI=None if page["url"] is None else one_line(page["url"]),
        WARC_Page_Id=page["page_id"],
        WARC_Refers_To=record_id(page["winner"], page["digest"]) if revisit else None,
        WARC_Refers_To_Page=page["winner"] if revisit else None,
        WARC_Profile=PROFILE if revisit else None,
        WARC_Payload_Digest=f"sha1:{page['digest']}",
        WARC_Payload_Length=page["payload_bytes"],
        Content_Type="text/html; charset=utf-8",
        Content_Length=len(payload),
    )
    deflate = zlib.compressobj(3, zlib.DEFLATED, 31)
    return deflate.compress(head + payload + b"\r\n\r\n") + deflate.flush()


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def capture_of(fields: dict[str, str], file: str, at: int, length: int) -> tuple:
    url = whole_url(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
    return url_key(url), fields.get("WARC-Page-Id"), file, at, length


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One record a row in files under `path`, which must be new; returns the captures (key, page, file, offset, length), stored beside them.

    Of equal payloads of LEAST_BYTES or more the one of the largest id is the response, the others revisit it. Null
    html is an empty payload. Rows of a null id are never the response of another; repeated rows of the winning id are
    all responses. `date` is the capture date of all (ISO 8601, UTC; now if none is given). A file is closed at
    `file_bytes`. Only (digest, size, id) is grouped; the pages stay where they lie while the payloads that occur
    again are up to a million, and are joined by a shuffle beyond.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    same = rows.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1 and winner is not null").drop("copies")
    same = written(same, "copies")
    joint = rows.join(F.broadcast(same) if same.count() <= BROADCAST_IDS else same, ["digest", "payload_bytes"], "left")
    kind = F.when(F.col("winner").isNull() | F.coalesce(F.col("page_id") == F.col("winner"), F.lit(False)), "response").otherwise("revisit")
    dated = date or spark.sql("select date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
    target = located(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        out, name, at, number = None, "", 0, 0
        try:
            for whole in batches:
                for part in slices(whole, "payload"):
                    found = []
                    for page in part.to_pylist():
                        if out is None or at >= file_bytes:
                            if out is not None:
                                out.close()
                            name, at, number = f"part-{context.partitionId():05}-{number:04}-{uuid.uuid4().hex}.warc.gz", 0, number + 1
                            out = store.open_output_stream(f"{root}/{name}", compression=None)
                        data = record(page, dated)
                        out.write(data)
                        found.append((url_key(page["url"]), None if page["page_id"] is None else str(page["page_id"]), name, at, len(data)))
                        at += len(data)
                    yield rows_of(found, CAPTURE)
        finally:
            if out is not None:
                out.close()
        give_back()

    made = joint.withColumn("record_type", kind).select("page_id", "url", "payload", "digest", "payload_bytes", "winner", "record_type")
    captures = f"{path}-captures"
    in_small_batches(made).mapInArrow(run, CAPTURE_DDL).write.parquet(captures)
    kept = spark.read.parquet(captures)
    remove_unnamed(target, kept)
    return kept


def remove_unnamed(target: str, captures: DataFrame) -> None:
    """Remove the files of attempts that Spark did not keep. The names are some per file of `file_bytes`, not per record."""
    store, root = fs.FileSystem.from_uri(target)
    if store.get_file_info(root).type == fs.FileType.NotFound:
        return
    named = {r.file for r in captures.select("file").distinct().toLocalIterator()}
    for info in store.get_file_info(fs.FileSelector(root)):
        if info.base_name not in named:
            store.delete_file(info.path)


def members(file, step: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member of an open file that holds something; one record is held at a time."""
    at, rest, ended = 0, b"", False
    while True:
        inflate, data, taken = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not rest:
                rest = file.read(step)
                if not rest:
                    if taken:
                        raise ValueError(f"the member at {at} breaks off")
                    return
            data.append(inflate.decompress(rest))
            taken += len(rest) - len(inflate.unused_data)
            rest = inflate.unused_data
        whole = b"".join(data)
        if whole:
            yield at, taken, whole
        at += taken


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all records in the files under `path`, whoever wrote them: a file is read as a stream by one task."""
    target = located(path)
    store, root = fs.FileSystem.from_uri(target)
    names = [(i.base_name,) for i in store.get_file_info(fs.FileSelector(root)) if i.is_file]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    found = []
                    for at, length, data in members(file):
                        found.append(capture_of(read_record(data)[0], name, at, length))
                        if len(found) >= 5000:
                            yield rows_of(found, CAPTURE)
                            found = []
                    yield rows_of(found, CAPTURE)

    listed = spark.createDataFrame(names, "file string").repartition(max(1, len(names)))
    return listed.mapInArrow(run, CAPTURE_DDL)


def build_index(spark: SparkSession, captures: DataFrame, path: str) -> None:
    """Sorted blocks of the captures and their directory, written to `path`/blocks and `path`/directory."""

    def blocks(batches):
        held: list[tuple] = []

        def packed(rows):
            lines = "\n".join(f"{k.encode('unicode_escape').decode()}\t{file}\t{at}\t{n}" for k, file, at, n in rows)
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([len(rows)], pa.int64()), pa.array([zlib.compress(lines.encode("utf-8", "surrogatepass"), 6)], pa.binary())], names=["first", "last", "n", "block"])

        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            while len(held) >= LINES:
                yield packed(held[:LINES])
                held = held[LINES:]
        if held:
            yield packed(held)

    ordered = captures.repartitionByRange("key", "page", "file", "offset").sortWithinPartitions("key", "page", "file", "offset")
    ordered.select("key", "file", "offset", "length").mapInArrow(blocks, "first string, last string, n long, block binary").withColumn("id", F.monotonically_increasing_id()).write.parquet(f"{path}/blocks")
    spark.read.parquet(f"{path}/blocks").select("id", "first", "last").write.parquet(f"{path}/directory")


def lookup(spark: SparkSession, index: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(key, file, offset, length) of every capture of the distinct URLs in `urls`; a null URL has the empty key.

    The directory (first and last key of each block) is broadcast up to BROADCAST_BLOCKS entries and searched by
    bisection. A larger one is met by range: keys and directory are sorted together and swept. Blocks that some key
    may lie in are then opened once each, with their keys behind them in sorted order.
    """
    directory, stored = spark.read.parquet(f"{index}/directory"), spark.read.parquet(f"{index}/blocks")

    @F.pandas_udf("string")
    def keys_of(own):
        return own.map(lambda u: url_key(u if isinstance(u, str) else None))

    wanted = urls.select(keys_of(F.col(f"`{url_col}`").cast("string")).alias("key")).distinct()
    if directory.count() <= BROADCAST_BLOCKS:
        top = sorted((r.first_, r.last_, r.id) for r in directory.selectExpr("first as first_", "last as last_", "id").collect())
        firsts, lasts = [t[0] for t in top], [t[1] for t in top]
        held = spark.sparkContext.broadcast((firsts, lasts, [t[2] for t in top]))

        def route(batches):
            firsts, lasts, ids = held.value
            for batch in batches:
                out = [(k, ids[i]) for k in batch.column(0).to_pylist() for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["key", "id"])

        routed = wanted.mapInArrow(route, "key string, id long")
    else:
        routed = swept(wanted, directory)
    both = routed.select("id", F.lit(1).alias("turn"), "key", F.lit(None).cast("binary").alias("block")).unionByName(stored.join(routed.select("id").distinct(), "id", "left_semi").select("id", F.lit(0).alias("turn"), F.lit(None).cast("string").alias("key"), "block"))

    def search(batches):
        lines, keys = [], []
        for batch in batches:
            out = []
            for turn, key, block in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if not turn:
                    lines = [x.split("\t") for x in zlib.decompress(block.as_py()).decode("utf-8", "surrogatepass").split("\n")]
                    keys = [x[0].encode().decode("unicode_escape") for x in lines]
                else:
                    out += [(key, x[1], int(x[2]), int(x[3])) for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])

    return both.repartition("id").sortWithinPartitions("id", "turn").mapInArrow(search, "key string, file string, offset long, length long")


def swept(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """(key, id) of the blocks whose key range holds each key, for a directory too large to broadcast: both are sorted by range and swept, blocks that reach into later parts copied there."""
    ends = directory.select(F.col("first").alias("key"), F.lit(0).alias("what"), "id", "last").unionByName(wanted.select("key", F.lit(1).alias("what"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("last")))
    dealt = written(ends.repartitionByRange("key").sortWithinPartitions("key", "what", "id").withColumn("part", F.spark_partition_id()), "sweep")
    bounds = dealt.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    reach = dealt.where("what = 0").alias("d").join(F.broadcast(bounds).alias("b"), (F.col("b.part") > F.col("d.part")) & (F.col("b.lo") <= F.col("d.last"))).select("d.key", "d.what", "d.id", "d.last", F.col("b.part").alias("part"))
    parts = dealt.unionByName(reach).repartition("part").sortWithinPartitions("part", "key", "what", "id")

    def sweep(batches):
        open_: list[tuple[str, int]] = []
        part = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["part"] != part:
                    open_, part = [], r["part"]
                if not r["what"]:
                    open_ = [x for x in open_ if x[0] >= r["key"]]
                    open_.append((r["last"], r["id"]))
                else:
                    out += [(r["key"], i) for last, i in open_ if last >= r["key"]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["key", "id"])

    return parts.mapInArrow(sweep, "key string, id long")


def ranges(found: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, records) of reads that cover sorted (offset, length): near ones together, none over READ_BYTES unless one record is."""
    held: list[tuple[int, int]] = []
    start = end = 0
    for at, length in found:
        if held and (at - end > GAP_BYTES or at + length - start > READ_BYTES):
            yield start, end, held
            held = []
        if not held:
            start = end = at
        held.append((at, length))
        end = max(end, at + length)
    if held:
        yield start, end, held


def fetch(spark: SparkSession, archives: str, captures: DataFrame, id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """The records at (file, offset, length): page_id, url, payload_bytes, payload_digest, record_type, refers_to [, payload].

    The places are dealt by file and stretch of READ_BYTES and sorted; a task seeks and reads their ranges of bytes.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))
    target = located(archives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        name, file = None, None
        try:
            for batch in batches:
                files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
                i = 0
                while i < len(files):
                    j = i
                    while j < len(files) and files[j] == files[i]:
                        j += 1
                    if files[i] != name:
                        if file is not None:
                            file.close()
                        name, file = files[i], store.open_input_file(f"{root}/{files[i]}")
                    for start, end, held in ranges(list(zip(offsets[i:j], lengths[i:j], strict=True))):
                        view = memoryview(file.read_at(end - start, start))
                        yield rows_of([row(*read_record(zlib.decompress(view[at - start : at - start + n], 31))) for at, n in held], schema)
                    i = j
        finally:
            if file is not None:
                file.close()
        give_back()

    def row(fields: dict[str, str], payload: bytes) -> tuple:
        kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"])
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"page {fields['WARC-Page-Id']}: the payload is not the one that was written")
        url = whole_url(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None
        return (fields.get("WARC-Page-Id"), url, size, digest, kind, fields.get("WARC-Refers-To-Page"), payload)[: len(names)]

    stretch = F.floor(F.col("offset") / READ_BYTES)
    dealt = captures.select("file", "offset", "length").repartition(F.col("file"), stretch).sortWithinPartitions("file", "offset")
    got = dealt.mapInArrow(run, ", ".join(f"{f.name} { {pa.int64(): 'long', pa.binary(): 'binary'}.get(f.type, 'string')}" for f in schema))
    return got.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives and index of `pages` in the shared folder, then every page read back through the index by its URL.

    One row for each row of `pages`; an empty table gives none. Null URLs have the empty key and are found by it;
    repeated rows are records of their own; null ids and html are read back as null and as an empty payload. A very
    long page is one record, held whole by the task that writes or reads it. Other columns, whatever their names, are
    not read. The shared folder must be one that Arrow opens (file, hdfs, s3, gs, abfs).
    """
    spark = pages.sparkSession
    root = scratch_path(spark, "warc")
    captures = write_archives(pages, f"{root}/archives", id_col, url_col, html_col)
    build_index(spark, captures, f"{root}/index")
    found = lookup(spark, f"{root}/index", pages, url_col)
    return fetch(spark, f"{root}/archives", found, pages.schema[id_col].dataType.simpleString())
