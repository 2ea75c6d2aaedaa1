"""Ranked lexical search: every query against all documents, its documents grouped by which of its terms they hold.

One pass over the texts counts words and keeps each document's query terms with their frequencies as a narrow table;
counts over that table give the weights. A second pass deals the table out in blocks. Within a block each term has a
posting list with the exact impact of each entry. For each query, bitmap operations give every document the mask of
the terms that it holds; a mask's largest possible score is the sum of its terms' largest weighted impacts in the
block. Distinct masks are evaluated by descending largest score until the next can't reach the `k` best, which carry
over from block to block of a task; ties are kept, so the results are exact. Each block returns at most `k` documents
a query, and two rankings, by part and over all, leave `k` in all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import as_bytes, col_of, give_back, in_small_batches, map_texts, passing, schema_of, slices, written
from .decontam import words_of

#: Bytes of query text whose terms are broadcast at once, with some for each row; more queries are searched in several passes.
QUERY_BYTES, ROW_BYTES = 8 << 20, 100
#: A block is at most so many documents, and ends after so many postings.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 21
#: Mask words (64 terms a word) that a query may fill at once: of a query of very many terms fewer documents are looked at together.
MASK_WORDS = 1 << 20
#: Parts that a query's candidates are ranked in before they meet.
PARTS = 64


def chunks_of(queries: DataFrame) -> DataFrame:
    """(id, text, row, chunk) of `queries`: each chunk holds at most QUERY_BYTES, or one longer query."""
    size = F.lit(ROW_BYTES) + F.coalesce(F.octet_length("text"), F.lit(0))
    total = queries.agg(F.sum(size).alias("n")).first().n or 0
    dealt = queries.repartition(max(1, -(-int(total) // QUERY_BYTES))).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    upto = F.sum(size).over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return written(dealt, "queries").withColumn("chunk", F.shiftleft(F.col("part").cast("long"), 32) + F.floor((upto - 1) / QUERY_BYTES)).drop("part")


def postings_of(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n: its terms with repeats, terms, tfs: the query terms that it holds) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def start():
        known = shared.value

        def of(batch: pa.RecordBatch) -> dict:
            n, terms, tfs = [], [], []
            for text in col_of(batch, "text").to_pylist():
                words = words_of(text)
                held = [(known[w], c) for w, c in Counter(words).items() if w in known]
                n.append(len(words))
                terms.append([t for t, _ in held])
                tfs.append([c for _, c in held])
            return {"doc_id": col_of(batch, "doc_id"), "n": n, "terms": terms, "tfs": tfs}

        return of

    return map_texts(docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("text")), "text", f"doc_id {kind}, n long, terms array<int>, tfs array<long>", start)


def frequencies(postings: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term: counted in tasks, summed, one row a query term to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for batch in batches:
            held += np.bincount(pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False), minlength=terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])

    table = postings.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, np.int64)
    out[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return out


class Block:
    """Documents in order of their ids with a posting list for each query term: places and impacts."""

    def __init__(self, table: pa.Table, terms: int):
        table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end")) if len(table) > 1 else table
        self.ids = table.column("doc_id").combine_chunks()
        lists = table.column("terms").combine_chunks()
        term = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(table), dtype=np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tf = pc.list_flatten(table.column("tfs").combine_chunks()).to_numpy(zero_copy_only=False)
        m = table.column("m").to_numpy()
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        order = np.argsort(term, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.stops = np.searchsorted(term[order], np.arange(terms + 1))
        full = self.stops[1:] > self.stops[:-1]
        self.top = np.zeros(terms, np.int64)
        if full.any():
            self.top[full] = np.maximum.reduceat(self.impact, self.stops[:-1][full])

    def __len__(self) -> int:
        return len(self.ids)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.stops[term], self.stops[term + 1]
        return self.doc[a:b], self.impact[a:b]


def exact(block: Block, terms: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The scores of these documents (places, ascending)."""
    out = np.zeros(len(docs), np.int64)
    for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
        at, impact = block.of(t)
        spot = np.minimum(np.searchsorted(at, docs), len(at) - 1)
        held = at[spot] == docs
        out[held] += w * impact[spot[held]]
    return out


def best_of(block: Block, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, scores, documents evaluated) of the k best documents of a block that reach `floor`; of equal scores the smaller ids."""
    held = (block.stops[terms + 1] > block.stops[terms]) & (weights > 0)
    terms, weights = terms[held], weights[held]
    most = weights * block.top[terms]
    order = np.argsort(-most, kind="stable")
    terms, weights, most = terms[order], weights[order], most[order]
    places, scores, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if not len(terms) or most.sum() < floor:
        return places, scores, seen
    needed = int((most[::-1].cumsum()[::-1] >= floor).sum())  # a document without any of the first `needed` terms can't reach the floor
    deep = -(-len(terms) // 64)
    step = max(64, MASK_WORDS // deep)
    for first in range(0, len(block), step):
        size = min(step, len(block) - first)
        masks, wanted = np.zeros((size, deep), np.uint64), np.zeros(size, bool)
        for j, t in enumerate(terms.tolist()):
            at = block.of(t)[0]
            if size < len(block):
                at = at[np.searchsorted(at, first) : np.searchsorted(at, first + size)]
            masks[at - first, j >> 6] |= np.uint64(1 << (j & 63))
            if j < needed:
                wanted[at - first] = True
        found = np.flatnonzero(wanted)
        if not len(found):
            continue
        keys = np.ascontiguousarray(masks[found])
        distinct, group = np.unique(keys[:, 0] if deep == 1 else keys.view(np.dtype((np.void, 8 * deep)))[:, 0], return_inverse=True)
        bits = distinct.view(np.uint64).reshape(len(distinct), deep)
        bound = np.zeros(len(distinct), np.int64)
        for j, most_of in enumerate(most.tolist()):
            bound += most_of * ((bits[:, j >> 6] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)
        by_bound = np.argsort(-bound, kind="stable")
        members = found[np.argsort(np.argsort(by_bound)[group], kind="stable")]  # group after group, by descending bound
        ends = np.cumsum(np.bincount(group, minlength=len(distinct))[by_bound])
        bound, done, share = bound[by_bound], 0, 2 * k
        while done < len(ends) and bound[done] >= max(floor, 1):
            begun = int(ends[done - 1]) if done else 0
            upto = int(np.searchsorted(ends, begun + share)) + 1
            upto = done + int((bound[done:upto] >= max(floor, 1)).sum())
            docs = np.sort(members[begun : int(ends[upto - 1])]) + first
            own = exact(block, terms, weights, docs)
            seen += len(docs)
            good = own >= max(floor, 1)
            places, scores = np.concatenate([places, docs[good]]), np.concatenate([scores, own[good]])
            if len(places) > k:
                kept = np.lexsort((places, -scores))[:k]
                places, scores = places[kept], scores[kept]
            if len(places) == k:
                floor = max(floor, int(scores.min()))
            done, share = upto, 2 * share
    return places, scores, seen


def searched(postings: DataFrame, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): the candidates of each block. `postings` has m; query q's terms are terms[offsets[q]:offsets[q + 1]]."""
    kind = postings.schema["doc_id"].dataType.simpleString()
    ddl = f"query int, doc_id {kind}, score long"
    schema = schema_of(postings, ddl)
    shared = postings.sparkSession.sparkContext.broadcast((offsets, terms, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, flat, weight = shared.value
        best = np.full((len(starts) - 1, k), -1, np.int64)  # the k best scores of each query in this task

        def search(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = Block(pa.Table.from_batches(parts), len(weight))
            queries, places, scores = [], [], []
            for q in range(len(starts) - 1):
                own = flat[starts[q] : starts[q + 1]]
                at, score, _ = best_of(block, own, weight[own], k, max(int(best[q, 0]), 0))
                if len(at):
                    best[q] = np.sort(np.concatenate([best[q], score]))[-k:]
                    queries.append(np.full(len(at), q, np.int32))
                    places.append(at)
                    scores.append(score)
            if not queries:
                return pa.RecordBatch.from_pylist([], schema)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries)), block.ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], schema=schema)

        held, docs, entries = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                size = len(pc.list_flatten(col_of(part, "terms")))
                if held and (docs + part.num_rows > BLOCK_DOCS or entries + size > BLOCK_POSTINGS):
                    yield search(held)
                    held, docs, entries = [], 0, 0
                held.append(part)
                docs, entries = docs + part.num_rows, entries + size
        if held:
            yield search(held)
        give_back()

    return in_small_batches(postings).mapInArrow(run, ddl)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank: by part first, so that no task ranks all candidates of a query."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = found.withColumn("__part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "__part").orderBy(*order))).where(F.col("rank") <= k)
    return few.drop("__part").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """(query's id, rank from 1, doc_id, score) of each query's `k` best documents with a score above 0; equal scores by ascending id.

    Terms are runs of digits, letters (A-Z lowered) and characters beyond ASCII, each of a query's once. N documents
    have a term, L terms in all, n a document, df documents hold the term, tf times each; a term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))), a document's m is 50 + (50 n N) div L, and its score the sum of
    weight * (10^9 tf div (1000 tf + 20 m)).

    Null and empty texts have no terms: such documents are never found, such queries give no rows. Each row of
    `queries` is a query of its own, also where ids repeat or are null. Repeated documents are ranked each; those of
    equal score and id in no stated order, null ids after all others. Empty tables give no rows. Whole texts are read,
    a very long one in one task; other columns, whatever their names, are not.
    """
    with passing(docs.sparkSession):
        asked = written(chunks_of(queries.select(F.col(f"`{query_col}`").alias("id"), as_bytes(query_text_col).alias("text"))), "chunks")
        out = docs.sparkSession.createDataFrame([], f"id {queries.schema[query_col].dataType.simpleString()}, rank int, doc_id {docs.schema[id_col].dataType.simpleString()}, score long")
        for chunk in sorted(r.chunk for r in asked.select("chunk").distinct().collect()):
            found = of_chunk(docs, asked.where(F.col("chunk") == chunk), k, id_col, text_col)
            out = out if found is None else out.unionByName(written(found, "found"))
        return written(out.withColumnRenamed("id", query_col), "ranked", keep=True)


def of_chunk(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame | None:
    """The results of the queries of one chunk, or None if they have no terms."""
    spark = docs.sparkSession
    texts = asked.select("row", "text").orderBy("row").collect()
    own = [set(words_of(bytes(r.text or b""))) for r in texts]
    number = {w: i for i, w in enumerate(sorted({w for ws in own for w in ws}))}
    if not number:
        return None
    offsets = np.cumsum([0, *map(len, own)])
    terms = np.array([number[w] for ws in own for w in ws], np.int64)
    postings = written(postings_of(docs, number, id_col, text_col), "postings")
    size = postings.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    weights = np.floor(1000 * np.log((2 * size.n + 2) / (2 * frequencies(postings, len(number)) + 1))).astype(np.int64)
    # 50 n N may pass 64 bits on a large corpus
    m = F.expr(f"cast(50 + (50 * cast(n as decimal(38, 0)) * {size.n}) div {max(int(size.l or 0), 1)} as bigint)")
    able = postings.where(F.size("terms") > 0).select("doc_id", "terms", "tfs", m.alias("m"))
    best = ranked(written(searched(able, offsets, terms, weights, k), "candidates"), k)
    rows = spark.createDataFrame(pa.table({"query": pa.array(range(len(texts)), pa.int32()), "row": pa.array([r.row for r in texts], pa.int64())}))
    return best.join(F.broadcast(rows.join(asked.select("row", "id"), "row")), "query").select("id", "rank", "doc_id", "score")  # as many rows as were collected
