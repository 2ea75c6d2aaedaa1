"""Prefix-tree formatting and archives: digests against brute force, whole trees by their intervals, round trips."""

import gzip
import hashlib
import re

from sentrel.llm import chat, queries, warc


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        out.setdefault(c, []).append((role or "", text or ""))
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


def read(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in queries.table(spark, sf_dir, "conversations").collect()]
    own = "<|im_end|><|im_start|>assistant ok"
    assert read(queries.op8_chat(spark, sf_dir)) == brute([*rows, (-1, 0, "user", own), (-1, 1, "assistant", own)])


def test_trees_share_and_attend(spark):
    odd = "a\\n<\\|<|im_end|>\n<"
    rows = []
    for c in range(40):
        turns = [("system", "be kind"), ("user", odd), ("assistant", f"x{c % 4}"), ("user", f"y{c % 8}"), ("assistant", "same <|"), ("us\ner", None)][: 2 + c % 5]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(100, None, None, None), (100, 1, "user", ""), (100, 1, "user", ""), (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as node", "1 as pack")
    want = brute([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert None in want
    for pack_chars in (1_000_000, 60):
        nodes, members = chat.format_trees(df, pack_chars=pack_chars)
        nodes = nodes.cache()
        assert read(chat.read_back(nodes, members)) == want
        packs = {}
        for r in sorted(nodes.collect(), key=lambda r: (r["pack"], r.start)):
            packs.setdefault(r["pack"], []).append(r)
        paths = {}
        for own in packs.values():
            text = "".join(r.segment for r in own)
            seen = set()
            for r in own:
                assert text[r.start : r.end] == r.segment
                path = "".join(text[a.start : a.end] for a in r.attends) + r.segment
                assert r.position == len(path) - len(r.segment) and path not in seen  # emitted once in its pack
                seen.add(path)
                if r.path_id is not None:
                    paths[r.path_id] = path
        for m in members.collect():
            turns = re.findall(r"<\|im_start\|>.*?<\|im_end\|>\n", paths[m.path_id], re.DOTALL)
            assert "".join(turns) == paths[m.path_id] and sha("".join("{}\n{}\n".format(*chat.parsed(t)) for t in turns)) == want[m.conv_id][1]
    assert len(packs) > 2


def test_shared_turns_are_emitted_once(spark):
    root = "r" * 1000
    rows = [(i, k, ("user", "assistant")[k], root if not k else f"answer {i}") for i in range(300) for k in range(2)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sizes = {}
        for most in (100_000, 20_000, 4000):
            nodes = chat.format_trees(made, pack_chars=most)[0].collect()
            sizes[most] = sum(r.depth == 0 for r in nodes), len({r.pack for r in nodes})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes[100_000] == sizes[20_000] == (1, 1) and sizes[4000][0] == sizes[4000][1] <= 6


def test_very_long_turns(spark):
    long = "x<|im_end|>\n\\" * 60_000
    made = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", long)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(*chat.format_trees(made)).collect()}
    assert got[1].turns_sha256 == sha(f"user\n{long}\nassistant\n{long}\n") and got[1].loss_sha256 == sha(long) and got[2].n_turns == 1


def test_chat_empty(spark):
    nodes, members = chat.format_trees(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(nodes, members).count() == 0


def brute_warc(pages):
    out, best = [], {}
    for p, _, h in pages:
        b = (h or "").encode()
        if len(b) >= 1000 and p is not None:
            best[b] = max(best.get(b, p), p)
    for p, _, h in pages:
        b = (h or "").encode()
        revisit = b in best and best[b] != p
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", best[b] if revisit else None))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_warc_whole_table(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in queries.table(spark, sf_dir, "pages").collect()]
    assert as_rows(queries.op9_warc(spark, sf_dir)) == brute_warc(pages)


def pages_of(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 80
    rows = [(i, f"http://h{i % 7}.example.com/p?q={i % 11}", f"{i % 5}{big}") for i in range(1200)]
    rows += [(5000, None, None), (5001, "", ""), (5002, "http://[bad", "small"), (5003, "x y\r\nz%0A\t", "small"), (None, "http://a.b/", f"0{big}"), (None, None, None), (1199, "http://h0.example.com/", f"{1199 % 5}{big}")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' as digest", "'k' as winner")


def test_warc_edges_and_sweep(spark, monkeypatch, tmp_path):
    rows, pages = pages_of(spark)
    root = f"file://{tmp_path}"
    captures = warc.write_archives(pages, f"{root}/archives", date="2024-01-02T03:04:05Z", file_bytes=20_000)
    warc.build_index(spark, captures, f"{root}/index")
    want = brute_warc(rows)
    assert spark.read.parquet(f"{root}/index/directory").count() > 1
    for most in (warc.BROADCAST_BLOCKS, 0):
        monkeypatch.setattr(warc, "BROADCAST_BLOCKS", most)
        found = warc.lookup(spark, f"{root}/index", pages)
        assert as_rows(warc.fetch(spark, f"{root}/archives", found)) == want
    one = warc.lookup(spark, f"{root}/index", spark.createDataFrame([("http://H3.example.com/p?q=3#x",), ("http://no.where/",)], "url string"))
    got = warc.fetch(spark, f"{root}/archives", one, with_payload=True).collect()
    assert {r.page_id for r in got} == {i for i in range(1200) if i % 7 == 3 and i % 11 == 3}
    files = list(tmp_path.glob("archives/part-*"))
    records = [r for f in files for r in gzip.decompress(f.read_bytes()).split(b"WARC/1.1\r\nWARC-Type")[1:]]
    assert len(records) == len(rows) and len(files) > 4
    assert sorted(map(tuple, warc.scan_archives(spark, f"{root}/archives").collect()), key=str) == sorted(map(tuple, captures.collect()), key=str)


def test_warc_records_hold_what_the_format_requires(tmp_path):
    page = {"page_id": 7, "url": "http://a.b/c", "digest": "ab", "payload_bytes": 3, "winner": None, "record_type": "response", "payload": b"xyz"}
    revisit = page | {"page_id": 5, "winner": 7, "record_type": "revisit"}
    first, second = (gzip.decompress(warc.record(p, "2024-01-02T03:04:05Z")) for p in (page, revisit))
    for data in (first, second):
        fields, _ = warc.read_record(data)
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n") and fields["WARC-Date"] == "2024-01-02T03:04:05Z"
        assert re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and {"WARC-Type", "Content-Length", "WARC-Target-URI"} <= fields.keys()
    assert warc.read_record(second)[0]["WARC-Refers-To"] == warc.read_record(first)[0]["WARC-Record-ID"] and warc.read_record(first)[1] == b"xyz"


def test_warc_look_ups_read_ranges():
    places = [(0, 100), (100, 50), (5 << 20, 70), (30 << 20, 9)]
    assert [(a, b) for a, b, _ in warc.ranges(places)] == [(0, 150), (5 << 20, (5 << 20) + 70), (30 << 20, (30 << 20) + 9)]
    many = [(i * 1000, 1000) for i in range(20_000)]
    assert all(b - a <= warc.READ_BYTES for a, b, _ in warc.ranges(many)) and sum(len(h) for _, _, h in warc.ranges(many)) == 20_000


def test_warc_empty(spark):
    _, pages = pages_of(spark)
    assert warc.archive_and_read(pages.limit(0)).count() == 0
