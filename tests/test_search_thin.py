"""Indicators by substring from a stored index, candidates thinned out before a shuffle, overviews of large cases."""

import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import cases, enrich, feeds, search
from sentrel.plans.catalog import QUERIES
from sentrel.plans.fixtures import Data


@pytest.fixture(scope="module")
def iocs(spark):
    draw = random.Random(3)
    part = lambda: "".join(draw.choice("abcAB.%_\\é0") for _ in range(draw.randrange(0, 9)))
    rows = [(i, "ip", part() + draw.choice(["evil.example", "Good.Org", "10.0.0.1", ""]) + part()) for i in range(400)]
    return spark.createDataFrame([*rows, (400, "ip", None), (401, "url", ""), (7, *rows[7][1:])], "id long, ioc_type string, ioc_value string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_the_index_finds_what_a_scan_finds(spark, iocs, tmp_path):
    search.index_iocs(iocs, f"{tmp_path}/i", 8)
    for value in ("evil", "EVIL.ex", "il.e%mple", "e_il.", "10.0.0.1", "org", "%", "", "_", "é", "ab", "abca", "no such thing", "a\\%b", "\\\\", "good.org%0", "%.%.%.1%"):
        found = search.find_iocs(spark, f"{tmp_path}/i", value, 8)
        assert found.columns == iocs.columns and ids(found) == ids(feeds.search_ioc(iocs.where("ioc_value is not null"), value)), value


def test_few_files_are_read(spark, tmp_path):
    many = spark.range(5000).select(F.col("id"), F.lit("ip").alias("ioc_type"), F.concat(F.md5(F.col("id").cast("string")), F.lit(".example")).alias("ioc_value"))
    search.index_iocs(many, f"{tmp_path}/i", 32)
    value = many.where("id = 4321").first().ioc_value[:12]
    found = search.find_iocs(spark, f"{tmp_path}/i", value, 32)
    assert ids(found) == [4321]
    assert "PartitionFilters: [part" in found._jdf.queryExecution().executedPlan().toString().replace("PartitionFilters: [isnotnull(part#", "PartitionFilters: [part")


EVENTS = "event_id string, source_ip string, destination_ip string, username string, hostname string, raw_log string"


def test_thinned_hits_are_all_hits(spark):
    events = spark.range(3000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.concat(F.lit("1.2.3."), F.col("id") % 900).alias("source_ip"), F.lit(None).cast("string").alias("destination_ip"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("u"), "id")).alias("username"), F.lit("").alias("hostname"), F.concat(F.lit("from 9.9."), F.col("id") % 250, F.lit(".1")).alias("raw_log"))
    iocs = spark.range(2000).select(F.col("id"), F.concat(F.lit("1.2.3."), F.col("id") * 7).alias("ioc_value"), F.lit("ip").alias("ioc_type"), F.lit("high").alias("threat_level"), F.lit(5).alias("confidence"))
    shown = lambda df: sorted((r.event_id, len(r.ioc_hits)) for r in df.collect())
    plain = shown(enrich.ioc_hits(events, iocs))
    anti = sorted(r.event_id for r in enrich.ioc_semi(events, iocs, has=False).collect())
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "100")
    try:
        assert enrich.too_large_to_broadcast(iocs)
        assert shown(enrich.ioc_hits(events, iocs)) == plain and sum(n for _, n in plain) > 300
        assert sorted(r.event_id for r in enrich.ioc_semi(events, iocs, has=False).collect()) == anti
        candidates, known = enrich.ioc_candidates(events), iocs.select(F.col("ioc_value").alias("value"))
        left, hits = enrich.thinned(candidates, known).count(), candidates.join(known, "value").count()
        assert hits <= left <= hits + 5 and candidates.count() > 6000  # what is shuffled is what is found
    finally:
        spark.conf.unset(limit)


def test_overviews_list_the_latest_and_count_the_rest(spark):
    incidents = spark.createDataFrame([("a",), ("b",)], "incident_id string")
    children = lambda n, *names: spark.range(n).select(F.lit("a").alias("incident_id"), *[F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 4, "0")).alias(c) for c in names])
    whole = cases.case_overview(incidents, children(30, "id", "filename"), children(500, "event_ts", "event_description"), children(3, "created_at", "title"), children(0, "ts", "action"), most=10)
    got = {r.incident_id: r for r in whole.collect()}
    assert (got["a"].timeline_total, got["a"].evidence_total, got["a"].artifacts_total, got["a"].audit_total) == (500, 30, 3, 0)
    assert [e.event_ts for e in got["a"].timeline] == [f"x{i:04}" for i in range(490, 500)] and len(got["a"].artifacts) == 3 and got["a"].audit == []
    assert got["b"].timeline == [] and got["b"].timeline_total == 0


def test_overviews_list_every_child_of_a_large_incident(spark):
    incidents = spark.createDataFrame([("a",), ("b",)], "incident_id string")
    children = lambda n, *names: spark.range(n).select(F.lit("a").alias("incident_id"), *[F.concat(F.lit("x"), F.lpad(F.col("id").cast("string"), 4, "0")).alias(c) for c in names])
    whole = cases.case_overview(incidents, children(1500, "id", "filename"), children(1200, "event_ts", "event_description"), children(3, "created_at", "title"), children(0, "ts", "action"))
    got = {r.incident_id: r for r in whole.collect()}
    assert [e.filename for e in got["a"].evidence] == [f"x{i:04}" for i in range(1500)] and got["a"].evidence_total == 1500
    assert len(got["a"].timeline) == got["a"].timeline_total == 1200 and got["b"].evidence == [] and got["b"].timeline_total == 0


def test_overviews_hold_whole_children_of_every_kind(spark, sf_dir):
    incidents = spark.createDataFrame([("a", "open")], "incident_id string, status string")
    rows = lambda values, ddl: spark.createDataFrame(values, f"incident_id string, {ddl}")
    entries = rows([("a", "t2", "later", "2"), ("a", "t1", None, None), ("a", "t3", "later", "2")], "timeline_id string, event_description string, event_ts string")
    whole = cases.case_overview(incidents, rows([("a", 1, "f", 7)], "id long, filename string, file_size long"), entries, rows([("a", "x", "t", "1")], "artifact_id string, title string, created_at string"), rows([("a", "did", 5)], "action string, ts long"))
    got = whole.first()
    assert got.status == "open" and [tuple(e) for e in got.timeline] == [(None, None, "t1"), ("2", "later", "t2"), ("2", "later", "t3")]
    assert got.evidence[0].file_size == 7 and got.artifacts[0].artifact_id == "x" and [tuple(r) for r in got.audit] == [(5, "did")]


def test_the_overview_query_lists_what_it_counts(spark, sf_dir):
    data = Data(spark, sf_dir)
    rows = QUERIES["case_overview"](spark, sf_dir).collect()
    listed = lambda kind: sorted(item.split(" ")[-1] for r in rows for item in (r[kind].split("|") if r[kind] else []))
    for kind, table, key in (("timeline", data.entries, "timeline_id"), ("artifacts", data.found, "artifact_id")):
        there = table.join(data.incidents, "incident_id", "left_semi").select(key).collect()
        assert listed(kind) == sorted(r[key] for r in there) and len(there) == sum(r[f"{kind}_total"] for r in rows) > 100
