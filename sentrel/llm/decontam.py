"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, and every training window against it.

Items are cut into windows of words in tasks and kept as a table. The set that is broadcast holds four bits of each
window's hash; its size follows the counted windows and ends at MOST_BITS, so it never grows past 32 MB. One pass over
the texts hashes their windows with numpy and keeps those that the set may hold, with their words; these few meet the
table of windows by hash and words, which verifies each hit word by word. Hits that overlap are then united.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import as_bytes, col_of, in_small_batches, map_texts, passing, row_key, slices, without_rows, written

#: Bytes of a word: digits, letters (A-Z become a-z) and all beyond ASCII; others become a space.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the set for each window, up to MOST_BITS in all: from 4 million windows on more candidates are false, and are dropped by the join.
BITS, MOST_BITS, PROBES = 64, 1 << 28, 4
WINDOWS = pa.schema([("n", pa.int32()), ("h", pa.int64()), ("words", pa.binary())])
CANDIDATES = "array<struct<start:long,n:int,h:long,words:binary>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def rolling(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, given by their hashes."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out *= BASE
        out += words[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def hashed(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """(words of each text, hashes of all words one text after the other, where each text ends)."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [words_of(t) for t in texts]
    ids = np.array([number[w] for own in split for w in own], np.int64)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    return split, hashes[ids] if len(ids) else np.zeros(0, np.uint64), np.cumsum([0, *map(len, split)])


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(item, n, h, words) of each item's distinct windows: `size` words, or all of an item that has fewer."""
    kind = benchmark.schema[item_col].dataType
    source = benchmark.select(F.col(f"`{item_col}`").alias("item"), as_bytes(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                split, hashes, ends = hashed(col_of(part, "text").to_pylist())
                items, rows = [], []
                for i, own in enumerate(split):
                    n = min(size, len(own))
                    for k, h in enumerate(rolling(hashes[ends[i] : ends[i + 1]], n).view(np.int64).tolist() if n else ()):
                        items.append(i)
                        rows.append((n, h, b" ".join(own[k : k + n])))
                columns = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(WINDOWS)]
                yield pa.RecordBatch.from_arrays([col_of(part, "item").take(pa.array(items, pa.int64())), *columns], names=["item", "n", "h", "words"])

    return in_small_batches(source).mapInArrow(run, f"item {kind.simpleString()}, n int, h long, words binary").distinct()


def slot(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th bit of the set that stands for each hash; `bits` is a power of two."""
    return (hashes + np.uint64(k) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


def hash_set(windows: DataFrame) -> tuple[np.ndarray, int]:
    """The set of all windows' hashes as 64-bit words, and its number of bits: of no window more than PROBES bits come to the driver, or MOST_BITS in all."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS * windows.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            at = np.concatenate([slot(hashes, bits, k) for k in range(PROBES)])
            word, inverse = np.unique(at >> np.uint64(6), return_inverse=True)
            held = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(held, inverse, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(held.view(np.int64))], names=["word", "bits"])

    table = windows.select("h").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out, bits


def may_hold(held: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the set."""
    found = np.arange(len(hashes))
    for k in range(PROBES):
        at = slot(hashes[found], bits, k)
        found = found[(held[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return found


def candidates(docs: DataFrame, held: tuple[np.ndarray, int], sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, print: 128 bits of the text, found: windows that the set may hold) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def start():
        bitmap, bits = shared.value

        def of(batch: pa.RecordBatch) -> dict:
            texts = col_of(batch, "text").to_pylist()
            split, hashes, ends = hashed(texts)
            found: list[list[dict]] = [[] for _ in texts]
            for n in sizes:
                rolled = rolling(hashes, n)
                at = may_hold(bitmap, bits, rolled)
                owner = np.searchsorted(ends, at, "right") - 1
                inside = at + n <= ends[owner + 1] if len(at) else np.zeros(0, bool)
                for a, d in zip(at[inside].tolist(), owner[inside].tolist(), strict=True):
                    k = a - int(ends[d])
                    found[d].append({"start": k, "n": n, "h": int(rolled[a].view(np.int64)), "words": b" ".join(split[d][k : k + n])})
            return {"doc_id": col_of(batch, "doc_id"), "n_words": np.diff(ends), "print": [xxhash.xxh3_128_digest(t or b"") for t in texts], "found": found}

        return of

    return map_texts(docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("text")), "text", f"doc_id {kind}, n_words long, print binary, found {CANDIDATES}", start)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13) -> DataFrame:
    """(doc_id, n_words, hits: spans of words, n_hit, items, contaminated) for each row.

    A window is `size` consecutive item words; an item with fewer words, but not none, is one window. A document is
    contaminated if n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words; items of a null id count
    as hits but are not listed; repeated items count once; an empty benchmark hits nothing. Repeated rows each get a
    row, and rows that share an id are each judged by their own text. A very long text is one row of one task; other
    columns, whatever their names, are not read.
    """
    with passing(docs.sparkSession):
        windows = written(windows_of(benchmark, item_col, item_text_col, size), "windows")
        sizes = sorted(r.n for r in windows.select("n").distinct().collect())
        passed = written(candidates(docs, hash_set(windows.select("h").distinct()), sizes, id_col, text_col), "candidates")
        able = passed.where(F.size("found") > 0)
        maybe = able.select("print", F.inline("found")).distinct()
        same = ["n", "h", "words"]
        spans = maybe.join(windows.select(*same).distinct(), same, "left_semi").select("print", "start", (F.col("start") + F.col("n")).alias("end"))
        ordered = Window.partitionBy("print").orderBy("start", "end")
        reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        united = spans.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
        united = united.groupBy("print", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        hits = united.groupBy("print").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
        items = maybe.join(windows, same).select("print", "item").distinct().groupBy("print").agg(F.array_sort(F.collect_list("item")).alias("items"))
        held = written(hits.join(items, "print", "left"), "hits")
        none = [F.array().cast(held.schema["hits"].dataType), F.lit(0).cast("long"), F.array().cast(held.schema["items"].dataType)]
        plain = passed.where(F.size("found") == 0).select("doc_id", "n_words", *[c.alias(n) for c, n in zip(none, ("hits", "n_hit", "items"), strict=True)])
        some = able.select("doc_id", "n_words", "print").join(held, "print", "left").select("doc_id", "n_words", *[F.coalesce(F.col(n), c).alias(n) for c, n in zip(none, ("hits", "n_hit", "items"), strict=True)])
        return written(plain.unionByName(some).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))), "contamination", keep=True)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without its contaminated rows, each judged by its own text, null and repeated ids too; columns stay."""
    key = row_key(id_col, text_col)
    keyed = docs.select(key.alias("__row"), F.col(f"`{text_col}`"))
    return without_rows(docs, decontaminate(keyed, benchmark, "__row", text_col, **options).where("contaminated").select("doc_id"), key)
