"""Vector codes: consecutive parts of each vector, coded by their nearest entries of codebooks learnt in rounds over all rows.

The nearest entry is sought through a memo of grid cells. A part's coarse cell is its components divided by the width
of a cell; the cell is a box, and an entry whose least distance to the box is above the smallest of all entries'
largest distances to it is dominated all over the box. A cell's other entries are cached under the hash of the cell,
and only these are evaluated exactly. Least and largest distances to a box are sums over its sides, and a component
meets few sides, so those are cached too: a cell that is new costs additions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, col_of, give_back, in_small_batches, passing, schema_of, written

#: Components are integers of SCALE steps a unit, held to REACH either way so that sums of squares stay within 64 bits.
SCALE, REACH = 1024, 1 << 26
ENTRIES, PARTS, ROUNDS = 256, 4, 4
#: Width of a grid cell in steps; cells and sides that a task remembers of a part before it begins anew.
WIDTH, MOST_CELLS, MOST_SIDES = 32, 1 << 16, 1 << 13
#: Parts that are looked at together.
ROWS = 2048


class Memo:
    """The nearest entries of one part's codebook, by memoised cells."""

    def __init__(self, book: np.ndarray, width: int = WIDTH):
        self.book, self.width = book, width
        self.cells: dict[bytes, np.ndarray] = {}
        self.sides: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(book.shape[1])]
        self.new = self.evaluated = 0

    def side(self, k: int, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) squared distance of component k of each entry to the side of the cells at this place."""
        known = self.sides[k]
        if at not in known:
            if len(known) >= MOST_SIDES:
                known.clear()
            low, own = at * self.width, self.book[:, k]
            high = low + self.width - 1
            near = np.maximum(0, np.maximum(low - own, own - high))
            far = np.maximum(np.abs(low - own), np.abs(high - own))
            known[at] = near * near, far * far
        return known[at]

    def undominated(self, cell: np.ndarray) -> np.ndarray:
        """The entries, ascending, that can be nearest somewhere in the cell, ties included."""
        near, far = np.zeros(len(self.book), np.int64), np.zeros(len(self.book), np.int64)
        for k, at in enumerate(cell.tolist()):
            a, b = self.side(k, at)
            near += a
            far += b
        return np.flatnonzero(near <= far.min())

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row; of equal distances the lower entry."""
        cells = np.ascontiguousarray(np.floor_divide(rows, self.width))
        held = []
        for key, cell in zip(cells.view(np.dtype((np.void, cells.strides[0])))[:, 0].tolist(), cells, strict=True):
            found = self.cells.get(key)
            if found is None:
                if len(self.cells) >= MOST_CELLS:
                    self.cells.clear()
                found = self.cells[key] = self.undominated(cell)
                self.new += 1
            held.append(found)
        sizes = np.array([len(h) for h in held])
        entry = np.concatenate(held)
        row = np.repeat(np.arange(len(rows)), sizes)
        self.evaluated += len(entry)
        distance = np.zeros(len(entry), np.int64)
        for k in range(rows.shape[1]):
            gap = rows[row, k] - self.book[entry, k]
            distance += gap * gap
        starts = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == least[row])  # the first of a row is its lowest entry
        return entry[hit[np.searchsorted(hit, starts)]], least


def components(vector: Column) -> Column:
    """Whole steps of each component, rounded down."""
    reach = float(REACH)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-reach), F.least(F.lit(reach), x.cast("double") * SCALE))).cast("long"))


def usable(vector: Column) -> Column:
    """The vector is there and all its components are finite numbers."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & whole


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = col_of(batch, name)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def assigned(kept: DataFrame, books: list[np.ndarray], ddl: str, out) -> DataFrame:
    """mapInArrow over `kept`; `out` gets each task's iterator of (batch, components, entries (rows, parts), distances) and yields record batches of `ddl`."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    schema = schema_of(kept, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [Memo(b) for b in shared.value]

        def coded() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    rows = matrix(part, "steps")
                    found = [m.nearest(rows[:, k * m.book.shape[1] : (k + 1) * m.book.shape[1]]) for k, m in enumerate(memos)]
                    yield part, rows, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

        yield from out(coded(), schema)
        give_back()

    return in_small_batches(kept).mapInArrow(run, ddl)


def sums(coded: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, sums) of a task's rows."""
    total = count = None
    for _, rows, entries, _ in coded:
        split = rows.reshape(len(rows), entries.shape[1], -1)
        if total is None:
            total, count = np.zeros((entries.shape[1], ENTRIES, split.shape[2]), np.int64), np.zeros((entries.shape[1], ENTRIES), np.int64)
        for p in range(entries.shape[1]):
            np.add.at(total[p], entries[:, p], split[:, p])
            count[p] += np.bincount(entries[:, p], minlength=ENTRIES)
    if total is not None:
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(total[part, entry]), schema.field("sums").type)], schema=schema)


def codes(coded: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, code, error) of each row."""
    for batch, _, entries, distances in coded:
        text = ["".join(f"{e:02x}" for e in row) for row in entries.tolist()]
        yield pa.RecordBatch.from_arrays([col_of(batch, "vec_id"), col_of(batch, "label"), pa.array(text, pa.string()), pa.array(distances.sum(1))], schema=schema)


def first_books(kept: DataFrame, parts: int) -> list[np.ndarray]:
    """The parts of the ENTRIES rows of the smallest ids, which all come to the driver; repeated ids by their steps."""
    rows = np.array([r.steps for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "steps").select("steps").limit(ENTRIES).collect()], np.int64)
    return [np.ascontiguousarray(b) for b in np.split(rows, parts, axis=1)]


def trained(kept: DataFrame, parts: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after `rounds` rounds over all rows: sums of each entry's parts are made in tasks, and one row an entry comes to the driver."""
    books = first_books(kept, parts)
    size = books[0].shape[1]
    for _ in range(rounds):
        found = assigned(kept, books, "part int, entry int, n long, sums array<long>", sums)
        total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(size)]).alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in total:
            books[r.part][r.entry] = [s // r.n for s in r.sums]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error), codebooks): two hex digits a part, the squared distance, and its sum over the rows of the label, nulls together.

    Components are floor(1024 x), held to 2^26 either way. A codebook begins as that part of the 256 smallest ids'
    vectors (fewer, where there are fewer); each of `rounds` rounds sets every entry to the rounded-down mean of the
    parts nearest to it, ties to the lower entry; entries that none is nearest to stay.

    Rows whose vector is null, empty, or holds null or non-finite components are dropped. All vectors have the length of
    the smallest id's: others are kept, with a null code and error, and count nowhere. Null ids come last, repeated
    ids and rows are rows of their own. An empty table gives no rows and no codebooks. Other columns, whatever their
    names, are not read. ValueError if the length is not a multiple of `parts`.
    """
    spark = vectors.sparkSession
    ddl = f"vec_id {vectors.schema[id_col].dataType.simpleString()}, label {vectors.schema[label_col].dataType.simpleString()}, code string, error long"
    with passing(spark):
        source = F.col(f"`{vector_col}`")
        rows = written(vectors.where(usable(source)).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), components(source).alias("steps")), "steps")
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "steps").select(F.size("steps").alias("n")).first()
        if first is None:
            return spark.createDataFrame([], f"{ddl}, label_error long"), []
        if first.n % parts:
            raise ValueError(f"vectors of {first.n} components can't be cut into {parts} equal parts")
        kept = rows.where(F.size("steps") == first.n)
        books = trained(kept, parts, rounds)
        coded = written(assigned(kept, books, ddl, codes).unionByName(rows.where(F.size("steps") != first.n).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))), "codes")
        whole = written(coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
        joint = coded.join(F.broadcast(whole) if whole.count() <= BROADCAST_IDS else whole, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
        return written(joint, "coded", keep=True), books


def decode(coded: DataFrame, books: list[np.ndarray], code_col: str = "code", out_col: str = "vector") -> DataFrame:
    """`coded` with the vector that each code stands for, null where there is none; the codebooks are small literals."""
    table = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in entry]) for entry in b.tolist()]) for b in books])
    entry = lambda k: F.conv(F.substring(F.col(f"`{code_col}`"), 2 * k + 1, 2), 16, 10).cast("int")
    return coded.withColumn(out_col, F.when(F.col(f"`{code_col}`").isNotNull(), F.flatten(F.array(*[F.get(F.get(table, F.lit(k)), entry(k)) for k in range(len(books))]))))
