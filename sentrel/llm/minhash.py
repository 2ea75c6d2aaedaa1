"""Near duplicates: universal-hash minima with banding, signature verification, confirmation on full sets, and
connected components by alternating large-star and small-star.

Documents of equal shingle sets are one class, represented by its smallest id; only representatives are compared.
In each bucket of a band every member is compared with the smallest and the largest member (a linear number of
pairs). Buckets of four or more whose members then still lie in several components are finished exactly: members meet
in blocks, signatures and then full sets are compared across components only, and the links found come out. So a pair
that shares a bucket is either in one component or was compared.

128 minima in 32 bands of 4: two sets of similarity 0.75 share no band with probability 5e-6, and lie below the
signature threshold of 0.55 with probability 1e-7.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ._shared import BROADCAST_IDS, as_bytes, col_of, map_texts, passing, row_key, without_ids, without_rows, written

WORDS = 5
MINIMA, BANDS = 128, 32
AT_LEAST = 0.55
BLOCK = 400

_draw = np.random.default_rng(20)
FACTOR = _draw.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _draw.integers(0, 2**63, MINIMA, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes. Fewer than WORDS words are one shingle, none give none."""
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids: list[int] = []
    stops = [0]
    for t in texts:
        if t:
            ids += map(number.__getitem__, t.lower().split())
        stops.append(len(ids))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    words = hashes[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
    n = len(words) - WORDS + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(WORDS if n > 0 else 0):
        rolled *= STEP
        rolled += words[k : k + n]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(stops, stops[1:], strict=False):
        if b - a >= WORDS:
            own = np.sort(rolled[a : b - WORDS + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            h = np.uint64(b - a)
            one = np.array([h], np.uint64)
            for w in words[a:b]:
                one = mixed(one * STEP + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima_of(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, MINIMA) smallest values of each hash function; all sets hold something."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((MINIMA, len(sets)), np.uint64)
    held = np.empty_like(flat)
    for k in range(MINIMA):
        np.multiply(flat, FACTOR[k], out=held)
        np.add(held, OFFSET[k], out=held)
        out[k] = np.minimum.reduceat(held, starts)
    return out.T


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, fingerprint of the set, bands, 16 bits of each minimum) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def of(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(col_of(batch, "text").to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            bands = np.zeros((len(sets), BANDS), np.int64)
            sig = [None] * len(sets)
            prints = np.zeros((len(sets), 2), np.uint64)
            if full:
                minima = minima_of([sets[i] for i in full])
                rows = minima.reshape(len(full), BANDS, -1)
                held = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.ones((len(full), 1), np.uint64)
                for k in range(rows.shape[2]):
                    held = mixed(held * STEP + rows[:, :, k])
                bands[full] = held.view(np.int64)
                short = (mixed(minima) >> np.uint64(48)).astype(np.uint16)
                for i, row in zip(full, short, strict=True):
                    sig[i] = row.tobytes()
                    prints[i] = sets[i].sum(dtype=np.uint64), mixed(sets[i] ^ STEP).sum(dtype=np.uint64)
            sizes = [BANDS if len(s) else 0 for s in sets]
            flat = pa.array(bands[full].ravel() if full else np.zeros(0, np.int64))
            return {
                "doc_id": col_of(batch, "doc_id"),
                "n_shingles": [len(s) for s in sets],
                "print1": prints[:, 0].view(np.int64),
                "print2": prints[:, 1].view(np.int64),
                "bands": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat),
                "sig": sig,
            }

        return of

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_texts(source, "text", f"doc_id {kind}, n_shingles long, print1 long, print2 long, bands array<long>, sig binary", start)


@F.pandas_udf(BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether so many minima of two signatures agree that the sets may be similar enough."""
    if not len(a):
        return pd.Series([], dtype=bool)
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), MINIMA) for s in (a, b))
    return pd.Series((x == y).mean(axis=1) >= AT_LEAST)


def close(n: str, m: str, percent: int):
    """Sets of these sizes can reach the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow a link."""
    one = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").where(close("na", "nb", percent)).where(alike("sa", "sb")).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= percent * |union| of the full shingle sets.

    The texts of the ids in `pairs` are dealt by (a, part of a's partners) with a's own text first, so a task holds
    one set and the one that it is compared with.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pairs = written(pairs.distinct(), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("long").alias("parts"))
    pairs = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    texts = selected(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), id_col, text_col)
    heads = pairs.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.col("a").alias("b"), "text")
    partners = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    schema = f"a {kind}, b {kind}"
    wanted = pa.schema([pa.field(c, pa.from_numpy_dtype(np.int64)) for c in "ab"]) if kind == "bigint" else None

    def run(batches):
        group, own = None, []
        for batch in batches:
            a, part, b = (col_of(batch, c).to_pylist() for c in ("a", "part", "b"))
            out = []
            sets = shingle_sets(col_of(batch, "text").to_pylist())
            for i, s in enumerate(sets):
                if (a[i], part[i]) != group:
                    group, own = (a[i], part[i]), []
                if a[i] == b[i]:
                    own.append(s)
                else:
                    for x in own:
                        both = len(np.intersect1d(x, s, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(s) - both):
                            out.append((a[i], b[i]))
                            break
            schema = wanted or pa.schema([pa.field("a", batch.schema.field("a").type), pa.field("b", batch.schema.field("b").type)])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], schema.field(k).type) for k in (0, 1)], schema=schema)

    dealt = heads.unionByName(partners).withColumn("head", (F.col("a") != F.col("b")).cast("int"))
    dealt = dealt.repartition(F.col("a"), F.col("part")).sortWithinPartitions("a", "part", "head")
    return dealt.select("a", "part", "b", "text").mapInArrow(run, schema).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in `edges` (a, b), a != b: stars around each component's smallest node.

    Large-star links each node's larger neighbours to its smallest one, small-star its smaller ones; the edges
    shrink to stars in a number of rounds that grows with the logarithm of the component's size.
    """
    stars = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "stars")
    sign = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("s")).first()
    before = sign(stars)
    for _ in range(rounds):
        if not before.n:
            break
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(stars.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), "m").where("v != m").distinct()
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        joint = large.join(least, "v")
        small = joint.select(F.col("m").alias("v"), F.col("least").alias("m")).where("v != m").unionByName(least.select("v", F.col("least").alias("m")))
        stars = written(small.distinct(), "stars")
        now = sign(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components have not settled in {rounds} rounds")
    return stars.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(stars.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())


def selected(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the rows whose id is in `ids`: broadcast while they are few, else joined by a shuffle."""
    ids = written(ids.distinct(), "ids")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("text"))
    return written(texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "texts")


class Block:
    """The members of one block of a bucket, or of two blocks that meet: which pairs are to be looked at here.

    A pair that shares several bands is looked at in the first of them only; sizes and signatures must allow a link,
    and the members' components must differ.
    """

    def __init__(self, pdf: pd.DataFrame, percent: int):
        self.pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        self.n, self.block = self.pdf["n_shingles"].to_numpy(), self.pdf["own"].to_numpy()
        self.within, self.band, self.percent = self.pdf["i"].iloc[0] == self.pdf["j"].iloc[0], self.pdf["band"].iloc[0], percent
        _, self.comp = np.unique(self.pdf["component"].to_numpy(), return_inverse=True)
        self.sig = np.frombuffer(b"".join(self.pdf["sig"]), np.uint16).reshape(len(self.pdf), MINIMA)
        self.bands = np.stack(self.pdf["bands"].to_list())

    def after(self, k: int) -> np.ndarray:
        """The later members that member k is to be compared with."""
        rest = np.arange(k + 1, len(self.pdf))
        rest = rest[(self.comp[rest] != self.comp[k]) & (100 * np.minimum(self.n[rest], self.n[k]) >= self.percent * np.maximum(self.n[rest], self.n[k]))]
        if not self.within:
            rest = rest[self.block[rest] != self.block[k]]
        if len(rest):
            rest = rest[(self.sig[rest] == self.sig[k]).mean(axis=1) >= AT_LEAST]
        if len(rest):
            rest = rest[self.bands[rest, (self.bands[rest] == self.bands[k]).argmax(axis=1)] == self.band]
        return rest


def block_candidates(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The members of a block that have someone to be compared with: (band, i, j, doc_id). Whole texts are fetched for these alone."""
    block = Block(pdf, percent)
    needed = np.zeros(len(pdf), bool)
    for k in range(len(pdf) - 1):
        rest = block.after(k)
        needed[rest] = True
        needed[k] |= len(rest) > 0
    return block.pdf.loc[needed, ["band", "i", "j", "doc_id"]]


def block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) across the components of one block, or between two blocks, of a bucket: enough to join what is linked."""
    block = Block(pdf, percent)
    ids, comp = block.pdf["doc_id"].to_numpy(), block.comp
    sets = shingle_sets(block.pdf["text"].to_list())
    number, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum([len(x) for x in sets])[:-1])
    mark = np.zeros(len(number), bool)
    a, b = [], []
    for k in range(len(block.pdf) - 1):
        rest = block.after(k)
        if not len(rest):
            continue
        mark[own[k]] = True
        for m in rest.tolist():
            if comp[m] != comp[k]:
                both = int(mark[own[m]].sum())
                if 100 * both >= percent * (len(own[k]) + len(own[m]) - both):
                    a.append(ids[k])
                    b.append(ids[m])
                    comp[comp == comp[m]] = comp[k]
        mark[own[k]] = False
    return pd.DataFrame({"a": a, "b": b}, columns=["a", "b"])


def across(buckets: DataFrame, comps: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The links that are still missing between components whose members share a bucket, confirmed on the full sets.

    Members of a bucket meet in blocks of about BLOCK, so that no task holds a whole bucket; links come out, not
    pairs. They meet by their signatures first; only those that then have someone to be compared with bring texts.
    """
    labelled = buckets.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = written(labelled, "labelled")
    open_ = labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("band", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    own = F.pmod(F.xxhash64("doc_id"), blocks)
    others = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    rows = labelled.join(open_, "band").select("band", "doc_id", "component", own.alias("own"), others.alias("others")).join(reps.select("doc_id", "n_shingles", "sig", "bands"), "doc_id")
    rows = written(rows, "open")
    members = rows.select("band", "doc_id", "component", "own", "n_shingles", "sig", "bands", F.inline("others"))
    kind = reps.schema["doc_id"].dataType.simpleString()
    needed = written(members.groupBy("band", "i", "j").applyInPandas(lambda pdf: block_candidates(pdf, percent), f"band long, i long, j long, doc_id {kind}"), "needed")
    texts = selected(docs, needed.select("doc_id"), id_col, text_col)
    dealt = needed.join(rows.drop("others"), ["band", "doc_id"]).join(texts, "doc_id")
    return dealt.groupBy("band", "i", "j").applyInPandas(lambda pdf: block_links(pdf, percent), f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; component_id is the smallest id reachable over links.

    Words are runs without white space (ASCII), A-Z lower-cased; a set holds the distinct 5-word shingles, or the
    whole sequence if it has fewer words. Texts without words, and null texts, are linked with nothing. Rows of a
    null id have component_id null and are kept, and link nothing. Ids should be unique; of rows that share one
    but not a text, each gets the component of its own text. An empty table gives no rows. A very long text is one
    row of one task, as a set of 8 bytes a shingle. Other columns of `docs`, whatever their names, are not read.
    """
    with passing(docs.sparkSession):
        sigs = written(signatures(docs, id_col, text_col), "signatures")
        key = ["n_shingles", "print1", "print2"]
        able = sigs.where("doc_id is not null and n_shingles > 0")
        classes = written(able.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
        reps = written(able.join(classes, key).where("doc_id = rep").dropDuplicates(["doc_id", *key]).select("doc_id", "n_shingles", "bands", "sig"), "reps")
        banded = reps.select("doc_id", F.explode("bands").alias("band"))
        shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo != hi")
        buckets = written(banded.join(shared, "band"), "buckets")
        ends = lambda c: buckets.select(F.least("doc_id", c).alias("a"), F.greatest("doc_id", c).alias("b")).where("a != b")
        tested = written(ends("lo").unionByName(ends("hi")).distinct(), "candidates")
        edges = written(confirmed(verified(tested, reps, percent), docs, id_col, text_col, percent), "links")
        comps = components(edges)
        more = written(across(buckets.where("n >= 4").select("band", "doc_id"), comps, reps, docs, id_col, text_col, percent), "links")
        if not more.isEmpty():
            stars = comps.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            comps = components(stars.unionByName(more))  # what is joined stays joined: only the stars move on
        rep = sigs.select("doc_id", *key).join(classes.withColumnsRenamed({k: f"c_{k}" for k in key}), [F.col(k) == F.col(f"c_{k}") for k in key], "left")
        found = rep.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "rep", "doc_id"))
        return written(found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "duplicates", keep=True)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """`docs` with one document of each component: that of the smallest id. Rows of a null id all stay.

    Where ids repeat, each distinct text of an id is a document of its own, and of rows that share both one stays:
    (id, text) pairs are numbered in the order of their ids and the numbers take the ids' place.
    """
    named = docs.where(F.col(f"`{id_col}`").isNotNull())
    if named.groupBy(F.col(f"`{id_col}`")).count().where("count > 1").isEmpty():
        found = near_duplicates(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col, percent)
        return without_ids(docs, found.where("not kept").select("doc_id"), id_col)
    key = row_key(id_col, text_col)
    pairs = named.select(F.col(f"`{id_col}`").alias("id"), key.alias("row")).distinct().orderBy("id", "row")
    numbers = written(pairs.select("row", F.monotonically_increasing_id().alias("n")), "numbers")
    few = numbers.count() <= BROADCAST_IDS
    keyed = named.select(key.alias("row"), F.col(f"`{text_col}`").alias("text"))
    numbered = written(keyed.join(F.broadcast(numbers) if few else numbers, "row").select("n", "text"), "numbered")
    gone = near_duplicates(numbered, "n", "text", percent).where("not kept").select(F.col("doc_id").alias("n")).distinct()
    some = without_rows(named, numbers.join(gone, "n").select("row"), key)
    return some.withColumn("__row", key).dropDuplicates(["__row"]).drop("__row").unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
