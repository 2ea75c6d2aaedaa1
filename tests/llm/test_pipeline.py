"""The corpus pipeline stage by stage: each stage's decisions against brute force on what it was given."""

import re

import corpus_pipeline
from public_tokenizers import path
from test_minhash import brute as brute_duplicates
from test_rules import brute as brute_rules
from test_text_ops import base, brute_decontam
from tokenizers import Tokenizer

from sentrel.llm import queries


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    items = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    lib = Tokenizer.from_file(path("word_bpe_49k.json"))
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count() and rows.keys() <= given.keys()
        if name == "quality rules":
            assert not any(brute_rules(r.text)[5] for r in rows.values())
            clean = [d for d, r in given.items() if not brute_rules(r.text)[5]]
            assert len(rows) > 0.8 * len(clean)
        elif name == "MinHash near-dedup":
            assert rows.keys() == {d for d, w in brute_duplicates([(d, r.text) for d, r in given.items()]).items() if w[2]}
        elif name == "benchmark decontamination":
            assert rows.keys() == {d for d, r in given.items() if not brute_decontam(r.text, items)[4]}
        elif name == "secret scans":
            assert rows.keys() == given.keys()
            for d, r in rows.items():
                assert r.text == given[d].text if not base(given[d].text) and "[format]" not in r.text else True
                assert not [s for s in base(r.text) if s[0] != "assign"]
        else:
            assert rows.keys() == given.keys()
            assert all(r.ids == lib.encode(given[d].text, add_special_tokens=False).ids for d, r in rows.items())
            break
        assert out.columns == docs.columns
        if name != "secret scans":
            assert all(r == given[d] for d, r in rows.items())
        given, docs = rows, spark.createDataFrame(list(rows.values()), docs.schema)


def test_run_is_the_stages(spark, sf_dir):
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()}
    docs = queries.table(spark, sf_dir, "documents")
    assert 0 < len(got) < docs.count()


def test_edges(spark, sf_dir):
    rows = [(1, None, None, "s", 0), (None, " ".join(f"w{i}" for i in range(99)), "en", None, 9), (2, "", "en", "s", 0), (3, "token = abcdef99 " * 3 + " ".join(f"v{i}" for i in range(99)), "de", "s", 5), (3, "token = abcdef99 " * 3 + " ".join(f"v{i}" for i in range(99)), "de", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as part", "1 as band", "2 as spans")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        kept = [r.doc_id for r in out.collect()]
        if name == "quality rules":
            assert sorted(kept, key=str) == [3, 3, None]
        elif name == "MinHash near-dedup":
            assert sorted(kept, key=str) == [1, 2, 3, None]
        else:
            assert len(kept) == len(rows)
        if name == "secret scans":
            texts = {r.doc_id: r.text for r in out.collect()}
            assert texts[3].startswith("[assign] [assign] [assign] v0") and re.search("w98$", texts[None])


def test_rows_of_null_and_repeated_ids(spark, sf_dir):
    item = queries.table(spark, sf_dir, "benchmark").where("length(text) > 200").first().text
    clean = lambda c: " ".join(f"{c}{i}" for i in range(99))
    texts = [(None, "a b"), (None, clean("w")), (7, clean("v")), (7, "a b"), (7, item), (None, item), (7, clean("u"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.ruled(spark, docs, sf_dir).collect()]
    assert "a b" not in {t for _, t in left} and {clean("w"), clean("v"), clean("u")} <= {t for _, t in left}
    left = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, sf_dir).collect()]
    assert sorted(left, key=str) == sorted([x for x in texts if x[1] != item], key=str)
    copy = clean("v").replace("v50 ", "")
    texts = [(7, clean("v")), (7, clean("u")), (7, clean("u")), (9, copy), (9, clean("w")), (-3, copy), (10, clean("w")), (11, None), (11, None), (None, "a b"), (None, clean("t"))]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.deduplicated(spark, docs, sf_dir).collect()]
    assert sorted(left, key=str) == sorted([(-3, copy), (7, clean("u")), (9, clean("w")), (11, None), (None, "a b"), (None, clean("t"))], key=str)


def test_operators_in_threads_leave_each_other_alone(spark, sf_dir):
    """Four operators at once, of which each deletes what it wrote on the way: the rows are those of one after the other."""
    from concurrent.futures import ThreadPoolExecutor

    from sentrel.llm import decontam, lexical, minhash, rules

    docs, bench = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "benchmark")
    work = [lambda: decontam.decontaminate(docs, bench), lambda: rules.quality_rules(docs), lambda: minhash.near_duplicates(docs), lambda: lexical.search(docs, bench, 5)]
    rows = lambda of: sorted(map(str, of().collect()))
    with ThreadPoolExecutor(4) as pool:
        together = list(pool.map(rows, work))
    assert together == [rows(w) for w in work] and all(together)
