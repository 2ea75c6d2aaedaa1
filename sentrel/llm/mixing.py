"""Mixing sources to target weights: how often each document is taken, by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should have on average. The whole
part is taken of all; of the fraction, pairs of documents of a source hand words to one another, in a random direction
that keeps either's expected share, until one of them is whole: taken once more or not. So a source's words are kept
from pair to pair, and one document a group is left with a fraction. Groups are dealt by the hash of the row, so hot
sources spread over many tasks; what groups leave meets in groups of the next level, a tree. At its root a source's
last ones meet as many of its documents, by hash, as a group holds, so that what is left of a large document can be
handed to small ones; the one document that is left then is rounded by itself. All draws are hashes of the rows and the seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import as_bytes, col_of, map_texts, passing, schema_of, written

#: Rows of a group, on average: of documents at the first level, of what groups left at the next ones.
GROUP = 1024
#: Up to so many sources (about 80 bytes each) are broadcast to their documents; beyond, the join shuffles.
BROADCAST_SOURCES = 200_000
NEARLY = 1e-9
WORD = (1 << 64) - 1
#: Which bytes are no white space.
WORD_BYTE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])


def source_key(source: Column) -> Column:
    """16 bytes for a source; null is one too."""
    return F.unhex(F.coalesce(F.md5(source.cast("string").cast("binary")), F.lit("00")))


def words_in(text: pa.Buffer | None) -> int:
    """Runs of bytes that aren't white space."""
    if text is None or not len(text):
        return 0
    inside = WORD_BYTE[np.frombuffer(text, np.uint8)]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, key: of the source, row: hash of id and text, size: words) of every row."""
    kinds = {n: docs.schema[c].dataType.simpleString() for n, c in (("doc_id", id_col), ("source", source_col))}
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), source.alias("source"), source_key(source).alias("key"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), text.cast("string")).alias("row"), as_bytes(text_col).alias("text"))

    def start():
        def of(batch: pa.RecordBatch) -> dict:
            return {c: col_of(batch, c) for c in ("doc_id", "source", "key", "row")} | {"size": [words_in(t.as_buffer()) for t in col_of(batch, "text")]}

        return of

    return map_texts(rows, "text", f"doc_id {kinds['doc_id']}, source {kinds['source']}, key binary, row long, size long", start)


def ranked_sources(sized: DataFrame) -> DataFrame:
    """(key, source, size, docs, place: from 0 in order of code points, null last): a range sort, and the counts of the partitions before."""
    own = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = F.col("source").asc_nulls_last()
    dealt = written(own.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "sources")
    before, total = [], 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():
        before += [F.lit(r.part), F.lit(total)]
        total += r["count"]
    start = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return dealt.withColumn("place", (start + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).cast("long")).drop("part")


def targets_of(sources: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """`sources` with `target`: share of all sizes by weight, at most cap times a source's size, the excess to the others by weight.

    What is not held by the cap has one rate a weight; each step, one aggregation, finds the rate from the sources that the last one did
    not hold, until it holds no more.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    table = written(sources.withColumn("weight", weight), "weights")
    total = share * int(table.agg(F.sum("source_size").alias("n")).first().n or 0)
    limit = (F.col("source_size") * cap).cast("double")
    rate, held = 0.0, -1
    while True:
        fixed = F.col("weight").cast("double") * rate >= limit if held >= 0 else F.lit(False)
        r = table.agg(F.count_if(fixed).alias("held"), F.sum(F.when(fixed, F.col("source_size") * cap)).alias("used"), F.sum(F.when(~fixed, F.col("weight"))).alias("weight")).first()
        if r.held == held or not r.weight:
            break
        held, rate = r.held, (total - (r.used or 0)) / r.weight
    return table.withColumn("target", F.least(limit, F.col("weight").cast("double") * rate) if r.weight else limit)


def mixed64(h: int) -> int:
    """A 64-bit finaliser."""
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & WORD
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & WORD
    return h ^ (h >> 31)


def drawn(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) from two rows and the seed."""
    return mixed64(mixed64((a & WORD) + 0x9E3779B97F4A7C15 * (seed + 1) & WORD) ^ (b & WORD)) / 2.0**64


def pivoted(rows: list[int], sizes: list[int], shares: list[float], seed: int) -> list[float]:
    """The shares of one group after rounding: 0 or 1, but for one at most. The sum of share times size stays, and so does each share's expectation."""
    out, left = list(shares), -1
    for i, p in enumerate(shares):
        if p <= NEARLY or p >= 1 - NEARLY:
            out[i] = float(round(p))
        elif left < 0:
            left = i
        else:
            a, b = out[left] * sizes[left], p * sizes[i]
            up, down = min(sizes[left] - a, b), min(a, sizes[i] - b)  # words that the earlier one can gain, and lose
            moved = up if drawn(rows[left], rows[i], seed) * (up + down) < down else -down
            out[left], out[i] = (a + moved) / sizes[left], (b - moved) / sizes[i]
            both = [k for k in (left, i) if NEARLY < out[k] < 1 - NEARLY]
            for k in {left, i} - set(both):
                out[k] = float(round(out[k]))
            left = both[0] if both else -1
    return out


def rounded(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """`rows` (key, group, row, doc_id, size, share and more) after one level; with `last`, a group's remaining one is rounded too.

    Groups come sorted, large documents first, and are streamed: a task holds a batch and the one open row.
    """
    schema = schema_of(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))

    def with_shares(table: pa.Table, shares: list[float]) -> pa.Table:
        return table.set_column(table.schema.get_field_index("share"), schema.field("share"), [pa.array(shares, pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, None

        def ended(row: pa.Table) -> pa.Table:
            h, p = row.column("row")[0].as_py(), row.column("share")[0].as_py()
            return with_shares(row, [float(drawn(h, 0, seed + 1) < p)]) if last else row

        for batch in batches:
            table, out = pa.Table.from_batches([batch]).cast(schema), []
            keys = list(zip(table.column("key").to_pylist(), table.column("group").to_pylist(), strict=True))
            stops = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            for a, b in zip([0, *stops], [*stops, len(keys)], strict=True):
                part = table.slice(a, b - a)
                if left is not None and keys[a] == now:
                    part = pa.concat_tables([left, part])
                elif left is not None:
                    out.append(ended(left))
                shares = pivoted(part.column("row").to_pylist(), part.column("size").to_pylist(), part.column("share").to_pylist(), seed)
                part, now = with_shares(part, shares), keys[a]
                still = [i for i, p in enumerate(shares) if 0.0 < p < 1.0]
                left = part.slice(still[0], 1) if still else None
                out.append(pa.concat_tables([part.slice(0, still[0]), part.slice(still[0] + 1)]) if still else part)
            yield from pa.concat_tables(out).combine_chunks().to_batches()
        if left is not None:
            yield from ended(left).to_batches()

    order = ["key", "group", F.col("size").desc(), "row", "doc_id"]
    return rows.repartition("key", "group").sortWithinPartitions(*order).mapInArrow(run, rows.schema)


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, cap: int = 3, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, row, size, source_size, target, copies) of every row: how often the mix takes it.

    Sources in order of their code points, null last, weigh `weights`, repeating, and share `share` of all words;
    a target ends at `cap` times its source's words and the excess goes to the others by weight. A document's copies
    are the whole number below or above its source's target over its size, the former for one without words.

    Null and empty texts have no words. Rows that share id and text are drawn for alike where their groups are sorted
    by; each has its own copies. Null ids are ids. An empty table gives no rows; if no source has words all targets
    are 0. A very long text is one row of one task; other columns, whatever their names, are not read.
    """
    with passing(docs.sparkSession):
        sized = written(sizes_of(docs, id_col, text_col, source_col), "sizes")
        sources = written(targets_of(ranked_sources(sized), weights, share, cap), "targets")
        known = sources.select(F.col("key").alias("__key"), "source_size", "target", "docs", (F.col("target") / F.nullif("source_size", F.lit(0))).alias("ratio"))
        known = F.broadcast(known) if sources.count() <= BROADCAST_SOURCES else known
        whole = F.coalesce(F.floor(F.col("ratio") + NEARLY), F.lit(0)).cast("long")
        rows = sized.join(known, F.col("key") == F.col("__key")).drop("__key").withColumn("whole", whole)
        rows = rows.withColumn("share", F.greatest(F.coalesce(F.col("ratio"), F.lit(0.0)) - F.col("whole"), F.lit(0.0))).drop("ratio")
        rows = rows.withColumn("share", F.when(F.col("size") > 0, F.col("share")).otherwise(0.0)).withColumn("groups", F.ceil(F.col("docs") / GROUP)).drop("docs")
        open_rows = (F.col("share") > NEARLY) & (F.col("share") < 1 - NEARLY)
        done, rows = rows.where(~open_rows).drop("groups"), rows.where(open_rows).withColumn("group", F.lit(0).cast("long"))
        late = (F.col("groups") <= 1) | (F.pmod(F.xxhash64("row", F.lit(seed)), F.col("groups")) == 0)
        top, level = rows.where(late), rows.where(~late)
        number, groups = 0, -(-int(sources.agg(F.max("docs").alias("n")).first().n or 0) // GROUP)
        while groups > 1:
            dealt = level.withColumn("group", F.pmod(F.xxhash64("row", F.lit(number)), F.col("groups"))).withColumn("groups", F.ceil(F.col("groups") / GROUP))
            settled = written(rounded(dealt, seed + 2 * number, False), f"level-{number}")
            done, left = done.unionByName(settled.where(~open_rows).drop("group", "groups")), settled.where(open_rows)
            top, level = top.unionByName(left.where("groups <= 1").withColumn("group", F.lit(0).cast("long"))), left.where("groups > 1")
            number, groups = number + 1, -(-groups // GROUP)
        done = done.unionByName(written(rounded(top, seed + 2 * number, True), "root").drop("group", "groups"))
        copies = (F.col("whole") + F.round("share")).cast("long").alias("copies")
        return written(done.select("doc_id", "source", "row", "size", "source_size", "target", copies), "mix", keep=True)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs`, each row as often as mix_sources takes it; all columns stay. Rows that share id, text and source take the copies of such rows in no stated order."""
    mix = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    same = ["__row", "__key", "__id"]
    nth = lambda by: F.row_number().over(Window.partitionBy(*same).orderBy(by))
    identity = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00"))
    taken = mix.select(F.col("row").alias("__row"), source_key(F.col("source")).alias("__key"), identity("doc_id").alias("__id"), "copies").withColumn("__nth", nth("copies")).where("copies > 0")
    keyed = docs.withColumns({"__row": F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")), "__key": source_key(F.col(f"`{source_col}`")), "__id": identity(id_col)}).withColumn("__nth", nth(F.lit(0)))
    joint = keyed.join(taken.withColumnRenamed("copies", "__copies"), [*same, "__nth"])
    return joint.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)
