"""Near duplicates against brute force: all pairs of whole sets, and components by union-find."""

import random
import re

import pytest

from sentrel.llm import minhash, queries


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    by: dict = {}
    for d, s in sets:
        if d is not None:
            for x in s:
                by.setdefault(x, []).append(d)
    own = {d: s for d, s in sets if d is not None}
    pairs = {(a, b) for ds in by.values() for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(own[a] & own[b])
        if 100 * both >= 75 * len(own[a] | own[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets if d is not None}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None}


def test_whole_table(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf_dir, "documents").collect()]
    want = brute(rows)
    assert sum(not w[2] for w in want.values()) > 20
    assert result(queries.op10_minhash(spark, sf_dir)) == want


def test_chains_and_crowds(spark):
    """Variants of one text whose links are partly below the limit, chains, and a crowd that shares a passage without links."""
    draw = random.Random(3)
    word = lambda: "w" + str(draw.randrange(10**6))
    rows, n = [], 0
    base = [word() for _ in range(60)]
    for _ in range(150):
        own = list(base)
        for k in draw.sample(range(60), draw.randrange(0, 4)):
            own[k] = word()
        rows.append((n := n + 1, " ".join(own)))
    chain = [word() for _ in range(80)]
    for _ in range(12):
        chain[draw.randrange(80)] = word()
        rows.append((n := n + 1, " ".join(chain)))
    passage = [word() for _ in range(60)]
    for _ in range(60):
        rows.append((n := n + 1, " ".join(passage + [word() for _ in range(30)])))
    draw.shuffle(rows)
    want = brute(rows)
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want


@pytest.mark.parametrize("block", [2])
def test_blocks(spark, monkeypatch, block):
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(30)]
    assert result(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_edges(spark):
    rows = [(1, "", "a"), (2, None, "b"), (3, "One two", "c"), (4, "one  TWO\n", "d"), (5, "two one", None), (None, "one two", "x"), (6, "   ", "x"), (7, "É x y z w v", "k"), (8, "é x y z w v", "k"), (9, "a b c d e " * 30000, "k"), (9, "a b c d e " * 30000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, band string")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[4] == (1, 3, False) and by[5] == (1, 5, True) and by[6] == (0, 6, True)
    assert by[None] == (1, None, True) and by[8] == (2, 8, True) and by[9] == (5, 9, True)
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
