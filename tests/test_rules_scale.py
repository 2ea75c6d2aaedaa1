"""Rules and thresholds at scale: bursts of one key in parts, many rules by their index, counts that meet matches only."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sentrel.operators import rules
from sentrel.operators.rules import Rule

T0 = dt.datetime(2024, 1, 1)


def brute(events, minutes):
    """Of (id, time, key): n of each id."""
    width = dt.timedelta(minutes=minutes)
    own = set(events)
    return {i: sum(k2 == k and at - width <= t2 <= at and (t2, i2) <= (at, i) for i2, t2, k2 in own) if k else 1 for i, at, k in own}


@pytest.fixture
def burst():
    draw = random.Random(4)
    rows = [(f"b{i:04}", T0 + dt.timedelta(seconds=draw.randrange(3)), "hot") for i in range(900)]  # a burst of ties
    rows += [(f"c{i:04}", T0 + dt.timedelta(minutes=draw.randrange(200)), draw.choice(["hot", "a", "b", "", None])) for i in range(300)]
    return rows + rows[:50]


@pytest.mark.parametrize("limit", [100, 10**9])
def test_bursts_count_right_in_parts(spark, burst, monkeypatch, limit):
    monkeypatch.setattr(rules, "BURST", limit)
    events = spark.createDataFrame(burst, "event_id string, ts timestamp, source_ip string")
    got = {r.event_id: r.n for r in rules.threshold_window(events, "source_ip", 15, "n").collect()}
    assert got == brute(burst, 15)


def test_a_burst_spreads_over_tasks(spark):
    """One key, one moment: the parts that are summed hold about as many rows each."""
    rows = spark.range(40_000).select(F.lit("n").alias("name"), F.lit("k").alias("key"), F.lit(0).cast("long").alias("bucket"), F.lit(5).cast("long").alias("place"), F.lit(0).alias("ends"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("event_id"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few bytes are one part
    spark.conf.set(name, "false")
    try:
        counted = rules.in_parts(rows).collect()
        dealt = rows.repartitionByRange(*rules.GROUP, *rules.PLACE).groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        spark.conf.unset(name)
    assert {r.n for r in counted} == set(range(1, 40_001))
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 20_000


def test_only_crowded_cells_are_split(spark):
    cells = spark.range(1000).select(F.when(F.col("id") < 900, 7).otherwise(F.col("id")).cast("int").alias("cell"))
    assert rules.crowded_cells(cells) == []
    rules_burst, rules.BURST = rules.BURST, 500
    try:
        assert rules.crowded_cells(cells) == [7]
    finally:
        rules.BURST = rules_burst


EVENT = "event_id string, ts timestamp, event_type string, event_category string, protocol string, destination_port int, source_port int, username string, source_ip string, severity string, raw_log string, parsed_data string, asset struct<id:long,criticality:string,hostname:string>, ioc_hits array<int>"


def random_rules(draw, n):
    some = lambda of, k: draw.sample(of, draw.randrange(1, k))
    out = []
    for k in range(n):
        logic = {}
        if draw.random() < 0.3:
            logic["eventTypes"] = some(TYPES, 3)
        if draw.random() < 0.2:
            logic["categories"] = some(["identity", "network"], 2)
        if draw.random() < 0.2:
            logic["usernames"] = some(USERS, 4)
        if draw.random() < 0.2:
            logic["destinationPorts"] = some([22, 80, "443"], 3)
        if draw.random() < 0.1:
            logic["protocols"] = ["tcp"]
        if draw.random() < 0.3:
            logic["anyKeywords"] = some(WORDS, 4)
        if draw.random() < 0.3:
            logic["allKeywords"] = some(WORDS, 3)
        if draw.random() < 0.1:
            logic["rawRegex"] = draw.choice([r"FAILED.*\d", "nm?ap", r"^x\b"])
        if draw.random() < 0.1:
            logic["matchIoc"] = True
        if draw.random() < 0.1:
            logic["assetCriticalities"] = some(["critical", "high", "low"], 3)
        if draw.random() < 0.2:
            logic["threshold"] = {"field": draw.choice(["sourceIp", "username", "odd"]), "count": draw.randrange(1, 6), "windowMinutes": draw.choice([5, 60])}
        out.append(Rule(k, f"R{k}", f"Rule {k}", draw.choice([None, "high"]), logic, draw.choice([None, "", "T1"]), draw.choice([None, "X"]), None, None, draw.choice([None, 10])))
    return out


TYPES, USERS = ["login", "scan", "port_scan", "malware_detected"], ["u1", "u2", "u3", ""]
WORDS = ["failed", "Nmap", "ab", "x", "root", "passw", '"message"', "login", "é€", "aab"]


def test_index_gives_what_the_projection_gives(spark):
    draw = random.Random(9)
    pick = lambda of: draw.choice([*of, None])
    rows = []
    for i in range(300):
        text = " ".join(draw.choice(["failed", "nmap", "aab", "x", "root 7", "passwd", "é€", "zz"]) for _ in range(draw.randrange(0, 6)))
        asset = draw.choice([None, (1, draw.choice(["critical", "low", None]), "h")])
        rows.append((f"e{i:03}", T0 + dt.timedelta(minutes=draw.randrange(120)), pick(TYPES), pick(["identity", "network"]), pick(["tcp"]), pick([22, 80, 443]), None, pick(USERS), pick(["1.1.1.1", "2.2.2.2"]), pick(["high", "low"]), draw.choice([text, None, ""]), draw.choice([None, '{"message":"Root"}']), asset, draw.choice([[], [1], [1, 2]])))
    events = spark.createDataFrame(rows, EVENT)
    chosen = random_rules(draw, 90)
    shown = lambda df: sorted((r.event_id, r.m) for r in df.select("event_id", F.to_json("match").alias("m")).collect())
    chunk = rules.CHUNK
    try:
        rules.CHUNK = 10**6
        want = shown(rules.evaluate_rules(events, chosen))
        rules.CHUNK = 0
        by_index = rules.evaluate_rules(events, chosen)
        assert by_index.columns == [*events.columns, "match"]
        got = shown(by_index)
    finally:
        rules.CHUNK = chunk
    assert got == want and len(want) > 2000


def test_rules_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_RULES", 2)
    table = spark.createDataFrame([(k, f"R{k}", f"Rule {k}", True, k) for k in range(3)], "id long, rule_id string, rule_name string, enabled boolean, updated_at int")
    for name, kind in (("detection_logic", "string"), ("pattern", "string"), ("severity", "string"), ("attack_technique", "string"), ("attack_tactic", "string"), ("threshold_count", "int"), ("threshold_window_minutes", "int"), ("confidence_weight", "int")):
        table = table.withColumn(name, F.lit(None).cast(kind))
    with pytest.raises(ValueError, match="more than 2"):
        rules.load_rules(table)
    assert len(rules.load_rules(table.where("id < 2"))) == 2


def test_a_job_parses_each_event_once_and_carries_no_indicators(spark):
    from sentrel.operators import detect

    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    logs = spark.range(300).selectExpr("cast(id as string) as event_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id as int)) as ts", "'raw' as source_type", "cast(null as long) as asset_id", "concat('port scan from 9.9.9.', id % 3) as payload")
    raw = logs.mapInArrow(passed, logs.schema)
    assets = spark.createDataFrame([(1, "h", "9.9.9.1", "high")], "id long, hostname string, ip_address string, criticality string")
    iocs = spark.range(500).selectExpr("id", "'ip' as ioc_type", "'9.9.9.2' as ioc_value", "'high' as threat_level", "1 as confidence")
    wanted = [rules.Rule(1, "R1", "Indicator", "high", {"matchIoc": True}), rules.Rule(2, "R2", "Busy", "high", {"threshold": {"field": "sourceIp", "count": 50, "windowMinutes": 60}})]
    rows = detect.ingest(raw, assets, iocs, None, wanted).collect()
    assert seen.value == 300
    assert sum(r.match.rule_id == "R1" for r in rows) == 100 and sum(r.match.rule_id == "R2" for r in rows) == 153
    assert all(r.ioc_hits == ["9.9.9.2"] for r in rows if r.match.rule_id == "R1")


def test_texts_of_events_stay_where_rules_test_them(spark):
    """No join of the job carries the raw log or the parsed payload to a result that has neither, and more rules than one number has bits for are told apart."""
    from sentrel.operators import detect

    wanted = [rules.Rule(k, f"R{k}", f"Rule {k}", "low", {"anyKeywords": [f"word{k:02}"]}) for k in range(2 * rules.PIECE + 3)]
    wanted.append(rules.Rule(99, "R99", "Busy", "low", {"threshold": {"field": "sourceIp", "count": 2, "windowMinutes": 5}}))
    schema = "event_id string, ts timestamp, event_type string, event_category string, severity string, source_ip string, destination_ip string, username string, hostname string, raw_log string, parsed_data string, protocol string, source_port int, destination_port int"
    events = spark.createDataFrame([(f"e{k:02}", T0 + dt.timedelta(hours=k), "t", "c", "low", f"1.1.1.{k}", None, None, None, f"a word{k:02}", None, None, None, None) for k in range(len(wanted))], schema)
    assets = spark.createDataFrame([], "id long, hostname string, ip_address string, criticality string")
    iocs = spark.createDataFrame([(1, "1.1.1.3")], "id long, ioc_value string")
    found = detect.evaluate(events, assets, iocs, wanted).select("event_id", "match.rule_id")
    assert sorted(map(tuple, found.collect())) == [(f"e{k:02}", f"R{k}") for k in range(2 * rules.PIECE + 3)]

    def joins(node):
        inner = node.children()
        own = [node] if node.nodeName() == "Join" else []
        return own + [j for i in range(inner.size()) for j in joins(inner.apply(i))]

    plan = found._jdf.queryExecution().optimizedPlan()
    carried = [{j.output().apply(i).name() for i in range(j.output().size())} for j in joins(plan)]
    assert carried and not any(c & {"raw_log", "parsed_data"} for c in carried)
