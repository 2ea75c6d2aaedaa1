"""Quality rules: the base statistics against brute force, the robust verdict on planted outliers, edge cases."""

import random
import re

import numpy as np

from sentrel.llm import queries, rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, failed


def test_statistics(spark, sf_dir):
    texts = {r.doc_id: r.text for r in queries.table(spark, sf_dir, "documents").collect()}
    got = {r.doc_id: r for r in queries.op7_rules(spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for d, t in texts.items():
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.kept and r.base_failed)


def test_many_words_take_two_steps():
    ids = np.array([1, 2, 1 << 22, 1, 2, 1 << 22, 5], np.int64)
    assert rules.repeated_words(ids) == 6 and rules.repeated_words(np.array([3, 4, 5, 3, 4, 5, 9])) == 6


def test_outliers(spark):
    draw = random.Random(1)
    line = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(n))
    rows = [(i, line(draw.randrange(60, 400)), "en", "s") for i in range(300)]
    rows += [(1000 + i, line(100).replace(" ", " ## "), "en", "s") for i in range(60)]  # a fifth of the group
    rows += [(2000, line(100).replace(" ", " ## "), "en", "few")]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i].kept for i in range(300)) >= 298
    assert not any(got[1000 + i].kept for i in range(60))
    assert not got[2000].kept and got[2000].distance > 100  # a small group is held against its language


def test_estimate_is_the_smallest_determinant(spark):
    """Small groups against the best of very many starts, and the determinant that the steps over all rows end with."""
    draw = np.random.default_rng(3)
    groups = {}
    for name, n, far in (("a", 90, 0.2), ("b", 60, 0.1), ("c", 400, 0.24)):
        x = draw.multivariate_normal(np.arange(5), np.diag([1, 0.5, 0.3, 2, 1.0]) + 0.2, n)
        x[: int(far * n)] += draw.normal(6, 0.3, (int(far * n), 5))
        groups[name] = x
    rows = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "grp string, x0 double, x1 double, x2 double, x3 double, x4 double")
    for r in rules.estimates(rows, 0.75, 600, 40, 30).collect():
        x = groups[r.grp]
        held = int(np.ceil(0.75 * len(x)))
        best = min((rules.concentrated(x, rules.fit_of(x[draw.choice(len(x), 6, replace=False)]), held, 30) for _ in range(500)), key=lambda f: f[2])
        ours = -np.linalg.slogdet(np.array(r.inv).reshape(5, 5))[1]
        assert ours < best[2] + 0.15 and np.abs(np.array(r["mean"]) - best[0]).max() < 0.25
        d = x - np.array(r["mean"])
        far = np.einsum("ni,ij,nj->n", d, np.array(r.inv).reshape(5, 5), d) / r.scale
        n_far = {"a": 18, "b": 6, "c": 96}[r.grp]
        assert far[:n_far].min() > 4 * np.quantile(far[n_far:], 0.99)


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (None, "a b", None, "s"), (3, "x y z " * 50000, "en", "s"), (3, "x y z " * 50000, "en", "s"), (4, " ".join(map(str, range(80))), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as grp", "2 as x0")
    got = [(r.doc_id, r.n_words, r.kept) for r in rules.quality_rules(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, False), (2, 0, False), (None, 2, False), (3, 150000, False), (3, 150000, False), (4, 80, True)], key=str)
    left = rules.without_rejected(docs)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [4]
    assert rules.quality_rules(docs.limit(0)).count() == 0


def test_small_groups_are_pooled(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(1)
    line = lambda n: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(n))
    odd = lambda: line(100).replace(" ", " ## ")
    rows = [(i, line(draw.randrange(60, 400)), "en", "s") for i in range(300)]
    rows += [(1000 + i, line(draw.randrange(60, 400)), "en", f"few{i}") for i in range(20)]  # by language
    rows += [(2000 + i, line(draw.randrange(60, 400)), ["xx", None][i % 2], None) for i in range(20)]  # over all rows
    rows += [(3000, odd(), "en", "few"), (3001, odd(), "xx", "few"), (3002, odd(), None, None), (3003, "a b", "yy", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    plain = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    assert all(abs(got[i].distance - plain[i].distance) < 1e-6 for i in range(300))
    assert sum(got[d].kept for d in got if 1000 <= d < 3000) >= 38
    assert not any(r.kept for d, r in got.items() if d >= 3000)
    kept = {r.doc_id: r.kept for r in queries.op7_rules(spark, str(tmp_path)).collect()}
    assert kept == {d: r.kept for d, r in got.items()}
    left = {r.doc_id for r in corpus_pipeline.ruled(spark, docs, str(tmp_path)).collect()}
    assert left == {d for d in kept if kept[d]}
    few = rules.quality_rules(docs.where("doc_id in (1, 2, 3003)")).collect()
    assert all(r.distance is not None and r.kept == (r.doc_id < 3) for r in few)
    assert rules.quality_rules(docs.where("doc_id = 3003")).first().distance is None
