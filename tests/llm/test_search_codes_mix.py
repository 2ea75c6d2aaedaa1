"""Ranked search, vector codes and mixing against brute force, with odd rows of each."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

from sentrel.llm import codes, lexical, mixing, queries

SF = "/root/testdata/sf0.001"


def terms_of(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, asked, k):
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in asked:
        scored = []
        for (doc, c), size in zip(held, sizes, strict=True):
            m = 50 + (50 * size * n) // total if total else 50
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, i, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def corpus():
    draw = random.Random(5)
    word = lambda: f"w{int(draw.paretovariate(0.6)) % 400}"
    docs = [(i, " ".join(word() for _ in range(draw.randrange(1, 60)))) for i in range(600)]
    docs += [(i, docs[7][1]) for i in range(600, 700)]  # ties
    docs += [(7, docs[7][1])] * 3 + [(None, docs[8][1]), (800, None), (801, ""), (802, "... ,"), (803, "W1 w1 Ünder w2-W3"), (804, "w5 " * 300_000 + "w9")]
    asked = [(i, " ".join(word() for _ in range(draw.randrange(1, 12)))) for i in range(12)]
    asked += [(2, docs[7][1]), (2, docs[7][1]), (None, "w1 ünder"), (20, None), (21, ""), (22, "never seen"), (23, " ".join(f"w{i}" for i in range(150)))]
    return docs, asked


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, corpus, monkeypatch, small):
    docs, asked = corpus
    if small:
        for name, value in (("QUERY_BYTES", 900), ("BLOCK_DOCS", 50), ("MASK_WORDS", 200)):
            monkeypatch.setattr(lexical, name, value)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, terms string, m int").repartition(3)
    q = spark.createDataFrame([(*r, 1, 2) for r in asked], "item_id long, text string, row int, chunk int")
    assert rows(lexical.search(d, q, 10)) == ranked(docs, asked, 10)


def test_search_stops_early_and_exactly(corpus):
    """Blocks evaluate few of their documents, and what they return is what all scores say."""
    import pyarrow as pa

    draw = np.random.default_rng(2)
    terms = [np.flatnonzero(draw.random(40) < 0.3) for _ in range(5000)]
    table = pa.table({"doc_id": list(range(5000)), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array([draw.integers(1, 4, len(t)) for t in terms], pa.list_(pa.int64())), "m": draw.integers(50, 200, 5000)})
    block = lexical.Block(table, 40)
    weights = draw.integers(0, 6000, 20)
    own = np.arange(0, 40, 2)
    places, scores, seen = lexical.best_of(block, own, weights, 10, 0)
    every = lexical.exact(block, own, weights, np.arange(5000))
    best = np.lexsort((np.arange(5000), -every))[:10]
    assert sorted(zip(places.tolist(), scores.tolist(), strict=True)) == sorted(zip(best.tolist(), every[best].tolist(), strict=True))
    assert seen < 2500
    assert not len(lexical.best_of(block, own, weights, 10, int(every.max()) + 1)[0])


def test_search_of_empty_tables(spark):
    docs, asked = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rows(lexical.search(docs.limit(0), asked)) == [] and rows(lexical.search(docs, asked.limit(0))) == []
    assert rows(lexical.search(docs, asked.select("item_id", asked.text.substr(9, 9).alias("text")))) == []


def coded(vectors, parts=4, rounds=4):
    """Brute force over (id, label, integer vector)."""
    x = np.array([v for _, _, v in vectors], np.int64).reshape(len(vectors), parts, -1)
    books = x[:256].copy()

    def nearest(p):
        d = ((x[:, p, None, :] - books[None, :, p, :]) ** 2).sum(2)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        near = [nearest(p)[0] for p in range(parts)]
        for p in range(parts):
            for e in set(near[p].tolist()):
                own = x[near[p] == e, p]
                books[e, p] = own.sum(0) // len(own)
    found = [nearest(p) for p in range(parts)]
    by = defaultdict(int)
    for i, (_, label, _) in enumerate(vectors):
        by[label] += int(sum(f[1][i] for f in found))
    return [(v, label, "".join(f"{f[0][i]:02x}" for f in found), int(sum(f[1][i] for f in found)), by[label]) for i, (v, label, _) in enumerate(vectors)]


def test_codes_equal_brute_force(spark):
    draw = np.random.default_rng(4)
    good = [(i, None if i % 7 == 0 else i % 3, (draw.normal(0, 0.2, 16) * (1 + i % 2)).tolist()) for i in range(900)]
    good += [(900 + i, 1, good[5][2]) for i in range(40)] + [(None, 2, [0.25] * 16), (2000, 2, [1e300, -1e300] + [0.0] * 14), (1, 0, good[3][2])]
    bad = [(3000, 1, None), (3001, 1, [None] + [0.0] * 15), (3002, 1, [float("nan")] * 16), (3003, 1, [float("inf")] * 16), (3004, 1, [])]
    odd = [(3005, 1, [0.5] * 12)]
    df = spark.createDataFrame([(*r, 1, 2) for r in good + bad + odd], "vec_id long, label int, embedding array<double>, part int, steps int").repartition(5)
    found, books = codes.compress(df)
    limit = codes.REACH
    steps = [(i, label, [max(-limit, min(limit, math.floor(x * 1024))) for x in v]) for i, label, v in good]
    steps.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = coded(steps)
    sums = {label: s for _, label, _, _, s in want}
    assert rows(found) == sorted([*want, (3005, 1, None, None, sums[1])], key=str)
    assert codes.decode(found.where("vec_id = 7"), books).first().vector == [x / 1024 for p, b in enumerate(books) for x in b[int(dict((r[0], r[2]) for r in want)[7][2 * p : 2 * p + 2], 16)].tolist()]


def test_codes_of_few_and_none(spark):
    ddl = "vec_id long, label int, embedding array<float>"
    assert rows(codes.compress(spark.createDataFrame([], ddl))[0]) == []
    found, books = codes.compress(spark.createDataFrame([(1, None, [1.0] * 8), (2, None, [2.0] * 8)], ddl))
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in found.orderBy("vec_id").collect()] == [(1, "00000000", 0, 0), (2, "01010101", 0, 0)]
    assert [b.shape for b in books] == [(2, 2)] * 4
    with pytest.raises(ValueError, match="4 equal parts"):
        codes.compress(spark.createDataFrame([(1, None, [1.0] * 6)], ddl))


def test_memo_is_exact_and_forgets(monkeypatch):
    draw = np.random.default_rng(1)
    for most in (1 << 16, 3):
        monkeypatch.setattr(codes, "MOST_CELLS", most)
        monkeypatch.setattr(codes, "MOST_SIDES", most)
        memo = codes.Memo(draw.integers(-300, 300, (256, 4)))
        x = draw.integers(-400, 400, (3000, 4))
        x[:500] = memo.book[draw.integers(0, 256, 500)]
        d = ((x[:, None] - memo.book[None]) ** 2).sum(2)
        entry, least = memo.nearest(x)
        assert (entry == d.argmin(1)).all() and (least == d.min(1)).all()
        assert memo.evaluated < 3000 * 256 / 4
    many = codes.Memo(memo.book)
    many.nearest(np.repeat(x[:100], 20, 0))
    assert many.new <= 100


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture
def sources():
    draw = random.Random(8)
    texts = lambda n, most: [" ".join(["x"] * draw.randrange(1, most)) for _ in range(n)]
    docs = [("big", t) for t in texts(4000, 60)] + [("a", t) for t in texts(300, 40)] + [("Ä", t) for t in texts(200, 30)] + [(None, t) for t in texts(150, 50)] + [("", t) for t in texts(20, 9)]
    docs += [("big", "y z " * 20_000), ("big", None), ("a", ""), ("z", None), ("a", " \t\x0b\r\n ")]
    docs += [("a", "same text here")] * 30
    return [(i if s != "Ä" else None, t, s) for i, (s, t) in enumerate(docs)]


def targets(docs):
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += words(t)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(size.values()))
    while True:
        rate = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * rate > 3 * size[s]}
        if not over:
            return size, out | {s: weight[s] * rate for s in free}
        for s in over:
            out[s] = 3.0 * size[s]
            left -= out[s]
        free -= over


def test_mix_meets_targets(spark, sources, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)  # three levels
    ddl = "doc_id long, text string, source string, key int, row int, share int"
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in sources], ddl)
    got = mixing.mix_sources(df.repartition(7)).collect()
    size, want = targets(sources)
    assert len(got) == len(sources)
    taken = defaultdict(int)
    for r in got:
        ratio = want[r.source] / size[r.source] if size[r.source] else 0
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert math.floor(ratio + 1e-6) <= r.copies <= math.ceil(ratio - 1e-6) or r.size == 0
        assert r.copies * r.size <= 3 * r.size
        taken[r.source] += r.copies * r.size
    for s in size:
        assert abs(taken[s] - want[s]) <= max(words(t) for _, t, of in sources if of == s), s  # one document is rounded by itself
    again = mixing.mix_sources(df.orderBy("text").coalesce(2)).collect()
    assert Counter((r.doc_id, r.row, r.copies) for r in got) == Counter((r.doc_id, r.row, r.copies) for r in again)
    other = mixing.mix_sources(df, seed=14).collect()
    assert Counter((r.doc_id, r.row, r.copies) for r in got) != Counter((r.doc_id, r.row, r.copies) for r in other)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert Counter((r.doc_id, r.text, r.source) for r in mixed.collect()) == Counter(x for r in _joined(got, sources) for x in r)


def _joined(got, sources):
    """Each source row as often as the mix takes it."""
    by = defaultdict(list)
    for d, t, s in sources:
        by[d, s, words(t)].append((d, t, s))
    for r in got:
        yield [by[r.doc_id, r.source, r.size].pop()] * r.copies if r.doc_id is not None or r.copies == 0 else []
    own = [x for x in sources if x[0] is None]
    left = Counter()
    for r in got:
        if r.doc_id is None and r.copies:
            left[r.row] += r.copies
    rows_of = {}
    for d, t, s in own:
        rows_of.setdefault(t, (d, t, s))
    keys = _row_keys([t for _, t, _ in own])
    for t, key in keys.items():
        yield [rows_of[t]] * left[key]


def _row_keys(texts):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(None, t) for t in set(texts)], "doc_id string, text string")
    return {r.text: r.k for r in df.select("text", F.xxhash64("doc_id", "text").alias("k")).collect()}


def test_rounding_keeps_expectation():
    draw = random.Random(2)
    n = 12
    sizes, shares = [draw.randrange(1, 50) for _ in range(n)], [draw.random() for _ in range(n)]
    taken, runs = np.zeros(n), 4000
    for seed in range(runs):
        out = mixing.pivoted(list(range(n)), sizes, shares, seed)
        assert sum(0 < p < 1 for p in out) <= 1
        assert sum(p * s for p, s in zip(out, sizes, strict=True)) == pytest.approx(sum(p * s for p, s in zip(shares, sizes, strict=True)))
        taken += [p if p in (0.0, 1.0) else float(mixing.drawn(i, 0, seed) < p) for i, p in enumerate(out)]
    assert np.abs(taken / runs - shares).max() < 0.04


def test_mix_of_nothing(spark):
    ddl = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], ddl)).collect() == []
    got = mixing.mix_sources(spark.createDataFrame([(1, None, "a"), (2, "", None)], ddl)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.copies) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_taken_words_of_the_table_come_near(spark):
    got = queries.op13_mixing(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "first", "size": "max"}).collect()
    assert got and all(abs(r["sum(taken)"] - r["first(target)"]) <= r["max(size)"] for r in got)


def test_ranks_are_whole(spark):
    by = defaultdict(list)
    for r in queries.op11_lexical(spark, SF).collect():
        by[r.item_id].append((r.rank, -r.score, r.doc_id))
    for found in by.values():
        found.sort()
        assert [r[0] for r in found] == list(range(1, len(found) + 1)) and len(found) <= 50
        assert all(a[1:] < b[1:] for a, b in pairwise(found))
