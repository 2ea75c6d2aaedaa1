"""Operators 4 and 6: gradients against differences, held-out accuracy over whole tables, edge cases."""

import os

os.environ.setdefault("OMP_NUM_THREADS", "1")

import numpy as np
from pyspark.sql import functions as F

from sentrel.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"
EDGES = [(1, None, "en"), (2, "", None), (3, "12 -- 34 🙂", "en"), (None, "the and of", "en"), (4, "the and of " * 40000, "de"), (4, "the and of " * 40000, "de"), (5, "x" * 500, None)]


def test_network_gradients():
    net = langid.Network(["a", "b", "c"], 5, 1)
    for w in (net.ahead, net.back):
        w.w, w.u, w.b = (x.astype(np.float64) for x in (w.w, w.u, w.b))
    net.v, net.c = net.v.astype(np.float64), net.c.astype(np.float64)
    x = np.random.default_rng(2).integers(97, 103, (4, 6)).astype(np.uint8)
    y = np.array([0, 1, 2, 1])

    def loss():
        p, _ = net.positions(x)
        return -np.log(p[np.arange(4), :, y]).mean()

    grads = net.gradients(x, y)
    draw = np.random.default_rng(3)
    for w, g in zip(net.weights(), grads, strict=True):
        for _ in range(6):
            at = tuple(int(draw.integers(s)) for s in w.shape) if w.shape[0] != 256 else (int(x.flat[draw.integers(x.size)]), int(draw.integers(w.shape[1])))
            old = w[at]
            w[at] = old + 1e-3
            up = loss()
            w[at] = old - 1e-3
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-4


def test_languages_held_out(spark):
    docs = queries.table(spark, SF, "documents")
    got = queries.op4_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 250 and right > 0.97


def test_languages_edges(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string").selectExpr("*", "'k' as lang_pred", "1 as h")
    rows = langid.identify(docs, None).collect()
    assert len(rows) == len(EDGES) and {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    net = langid.Network(["de", "en"], 4, 1)
    by = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert {d for d, r in by.items() if r.lang_pred == "und"} == {1, 2, 3} and all(0 <= r.score <= 1 for r in by.values())
    assert by[None].held_out is False
    assert langid.train(docs.limit(0)) is None and langid.identify(docs.limit(0), net).count() == 0


def test_windows_label_every_position_once():
    net = langid.Network(["de", "en"], 4, 1)
    text = b"the words " * 37 + b"x" * 300
    x, own = langid.windows_of(text)
    assert own.sum() == len(text) and b"".join(bytes(w[langid.EDGE : langid.EDGE + n]) for w, n in zip(x, own)) == text
    sums = net.pooled(x, own)
    for k in (0, 2, len(x) - 1):  # as the network itself labels the window's positions
        whole, _ = net.positions(x[k : k + 1, : langid.EDGE + langid.OWN])
        _, (both, _, _) = net.positions(x[k : k + 1])
        ahead = both[0, :, :4]
        back, _ = net.back.forward(x[k : k + 1, langid.EDGE :][:, ::-1])
        logits = np.concatenate([ahead[langid.EDGE : langid.EDGE + langid.OWN], back[::-1, 0][: langid.OWN]], 1) @ net.v + net.c
        p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
        assert np.allclose(p[: own[k]].sum(0), sums[k], atol=1e-3) and whole.shape[1] == langid.EDGE + langid.OWN


def test_grades(spark):
    got = queries.op6_quality(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id")
    kept = {(r.quality, r.toxic): (r.k, r.n) for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.count("*").alias("n")).collect()}
    assert kept[(1, 0)][0] > 0.97 and kept[(1, 1)][0] < 0.1 and kept[(0, 0)][0] < 0.2


def test_grades_held_out(spark):
    """Two thirds of the ratings train, the others judge."""
    docs, ratings = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    ratings = ratings.withColumn("out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = quality.train(docs, ratings.where("not out"), F.expr(queries.GRADE))
    got = quality.grade_documents(docs, model).join(ratings.where("out"), "doc_id").select("grade", "kept", "quality", F.expr(queries.GRADE).alias("true")).where("true is not null").collect()
    mean = [np.mean([r.grade for r in got if r.true == g]) for g in range(3)]
    assert mean[0] + 0.3 < mean[1] and mean[1] + 0.3 < mean[2]
    kept = lambda g: np.mean([r.kept for r in got if r.true == g])
    assert kept(2) > 0.98 and kept(1) < 0.3 and kept(0) < 0.15


def test_likelihood_against_differences():
    """At the fitted weights no single weight or threshold can be moved to a better penalised likelihood."""
    draw = np.random.default_rng(8)
    grades = draw.integers(0, 3, 300)
    rows = [sorted({int(g) * 5 + int(k) for k in draw.integers(0, 8, 4)}) for g in grades]
    model = quality.fit(rows, grades, steps=1500)

    def loss(weight, limits):
        score = np.array([sum(weight.get(b, 0.0) for b in r) for r in rows])
        cdf = quality.sigmoid(np.c_[np.full(300, -50.0), limits[None, :] - score[:, None], np.full(300, 50.0)])
        return -np.log(cdf[np.arange(300), grades + 1] - cdf[np.arange(300), grades]).mean() + 3e-4 * sum(map(abs, weight.values()))

    best = loss(model.weight, model.thresholds)
    for b in list(model.weight)[:6]:
        for step in (0.3, -0.3):
            assert loss(model.weight | {b: model.weight[b] + step}, model.thresholds) > best - 1e-4
    for k in range(2):
        for step in (0.2, -0.2):
            assert loss(model.weight, model.thresholds + step * (np.arange(2) == k)) > best - 1e-4


def test_ordinal_fit_orders_grades():
    draw = np.random.default_rng(4)
    grades = draw.integers(0, 4, 600)
    rows = [sorted({int(g) * 10 + int(k) for k in draw.integers(0, 10, 6)} | {100 + int(draw.integers(50))}) for g in grades]
    model = quality.fit(rows, grades)
    assert (np.diff(model.thresholds) > 0).all()
    expected = model.above(np.array([sum(model.weight.get(b, 0) for b in r) for r in rows])).sum(1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95
    assert quality.fit(rows, np.zeros(600, np.int64)) is None


def test_grade_edges(spark):
    docs = spark.createDataFrame([e[:2] for e in EDGES], "doc_id long, text string").selectExpr("*", "'k' as grade", "1 as tail")
    rows = quality.grade_documents(docs, None).collect()
    assert len(rows) == len(EDGES) and all(r.kept and r.grade is None for r in rows)
    ratings = spark.createDataFrame([(4, 0), (4, 1), (5, 1), (None, 1), (1, None)], "doc_id long, g int")
    model = quality.train(docs, ratings, F.col("g"))
    by = {r.doc_id: r for r in quality.grade_documents(docs, model).collect()}
    assert len(by) == 6 and by[1].grade == by[2].grade is not None
    assert quality.train(docs, ratings.limit(0), F.col("g")) is None


def test_every_language_is_learned(spark):
    names = [f"l{i:02}" for i in range(80)]
    rows = [(i * 3 + k, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, n) for i, n in enumerate(names) for k in range(3)] + [(1000 + i, "zz yy", "l00") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    able = {r.lang for r in docs.where(~langid.held_out("doc_id")).collect()}
    assert len(able) > 64 and langid.train(docs, epochs=1).labels == sorted(able)
    words, langs = langid.sample(docs, "doc_id", "text", "lang", 2, 40, 48)
    assert len(words) == len(langs) and len(set(langs)) > 64
