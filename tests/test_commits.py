"""Facts of batches and streams in one path: committed as wholes, written once, counted, made one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentrel.operators import feeds
from sentrel.sources import commits, tables
from sentrel.sources.schemas import TABLES
from sentrel.streaming.detect import stream_detect

from test_golden import scenario

T0 = dt.datetime(2024, 1, 1)


def alerts(spark, *rows):
    """Of (id, severity, day)."""
    return spark.createDataFrame([(i, s, "new", None if d is None else T0 + dt.timedelta(days=d, minutes=int(i[1:]))) for i, s, d in rows], "alert_id string, severity string, status string, ts timestamp")


def ids(df, name="alert_id"):
    return sorted(r[name] for r in df.collect())


def test_runs_are_written_once_and_whole(spark, tmp_path):
    path = str(tmp_path)
    first = alerts(spark, ("a1", "high", 0), ("a2", "odd", 0), ("a3", None, None))
    assert tables.write_facts({"alerts": first}, path, "one/1")
    assert not tables.write_facts({"alerts": alerts(spark, ("a9", "low", 1))}, path, "one/1")
    assert tables.write_facts({"alerts": alerts(spark, ("a4", "high", 1))}, path)
    # a write that died before its commit, and one that lost against another of the same run
    alerts(spark, ("a7", "low", 1)).withColumn("kept", F.lit(True)).write.partitionBy("kept").parquet(f"{path}/alerts/run=died")
    read = lambda: tables.read_table(spark, "alerts", f"{path}/alerts")
    assert ids(read()) == ["a1", "a3", "a4"]
    assert [(r.alert_id, r.reject_reason) for r in tables.read_rejected(spark, "alerts", f"{path}/alerts").collect()] == [("a2", "severity=odd")]
    kept = commits.counts(spark, path)["alerts"]
    assert (kept[""], kept["severity=high"], kept["severity=low"]) == (3, 2, 0)
    assert tables.compact_facts(spark, path) and len(commits.committed(spark, path)) == 1
    assert ids(read()) == ["a1", "a3", "a4"] and commits.counts(spark, path)["alerts"][""] == 3
    assert tables.read_rejected(spark, "alerts", f"{path}/alerts").count() == 1
    assert not tables.write_facts({"alerts": first}, path, "one/1"), "a run that was made part of another one is still written"
    assert len(commits.vacuum(spark, path, ["alerts"])) == 3 and ids(read()) == ["a1", "a3", "a4"]
    assert not tables.compact_facts(spark, path)
    assert len(list((tmp_path / "_commits").glob("*.json"))) == 1 and not tables.write_facts({"alerts": first}, path, "one/1")


def test_what_is_made_one_twice_stays_one(spark, tmp_path):
    path = str(tmp_path)
    read = lambda: ids(tables.read_table(spark, "alerts", f"{path}/alerts"))
    for k in range(2):
        tables.write_facts({"alerts": alerts(spark, (f"a{k}", "high", 0))}, path, f"r{k}")
    assert tables.compact_facts(spark, path)
    tables.write_facts({"alerts": alerts(spark, ("a5", "high", 0))}, path, "r5")
    assert tables.compact_facts(spark, path)
    commits.vacuum(spark, path, ["alerts"])
    assert read() == ["a0", "a1", "a5"] and len(commits.committed(spark, path)) == 1
    assert not any(tables.write_facts({"alerts": alerts(spark, ("a9", "high", 0))}, path, r) for r in ("r0", "r1", "r5"))


def test_put_once(spark, tmp_path):
    assert commits.put_once(spark, f"{tmp_path}/x.json", "1") and not commits.put_once(spark, f"{tmp_path}/x.json", "2")
    assert (tmp_path / "x.json").read_text() == "1" and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]


def test_one_that_loses_the_race_leaves_nothing(spark, tmp_path, monkeypatch):
    assert tables.append_rows(alerts(spark, ("a1", "high", 0)), "alerts", str(tmp_path), "r")
    monkeypatch.setattr(commits, "is_committed", lambda *_: False)
    assert not tables.append_rows(alerts(spark, ("a2", "high", 0)), "alerts", str(tmp_path), "r")
    assert ids(tables.read_table(spark, "alerts", str(tmp_path))) == ["a1"] and len(list(tmp_path.glob("run=*"))) == 1


def test_only_runs_in_the_span_are_read(spark, tmp_path):
    for day in range(4):
        tables.write_facts({"alerts": alerts(spark, (f"a{day}", "low", day))}, str(tmp_path))
    near = commits.read_runs(spark, "alerts", str(tmp_path), TABLES["alerts"], first="2024-01-02", last="2024-01-03 12:00:00")
    assert ids(near) == ["a1", "a2"]
    assert commits.read_runs(spark, "incidents", str(tmp_path), TABLES["incidents"]).count() == 0


def test_batch_and_two_streams_share_a_path(spark, tmp_path):
    raw, assets, iocs, cves, loaded = scenario(spark, "web-01")
    out = f"{tmp_path}/out"
    for name, part in (("x", "event_id = 'e0'"), ("y", "event_id = 'e1'")):
        raw.where(part).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        stream_detect(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/{name}"), assets, iocs, cves, loaded, out, f"{tmp_path}/cp-{name}", once=True).awaitTermination()
    events = lambda: tables.read_table(spark, "security_events", f"{out}/security_events")
    assert ids(events(), "event_id") == ["e0", "e1"]
    tables.write_facts({"security_events": spark.createDataFrame([("b", T0)], "event_id string, ts timestamp")}, out)
    assert ids(events(), "event_id") == ["b", "e0", "e1"]
    # the third log-in, by a third stream that also brings what the first ones brought
    raw.coalesce(1).write.parquet(f"{tmp_path}/z")
    stream_detect(spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/z"), assets, iocs, cves, loaded, out, f"{tmp_path}/cp-z", once=True).awaitTermination()
    assert ids(events(), "event_id") == ["b", "e0", "e1", "e2"]
    assert tables.read_table(spark, "alerts", f"{out}/alerts").count() == 1


def test_counts_follow_changes(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(f"i{k}", "open", "high") for k in range(5)], "incident_id string, status string, severity string")
    tables.write_facts({"incidents": rows}, path)
    changes = spark.createDataFrame([("open", "resolved")] * 2 + [("open", "odd"), (None, "open")], "before string, after string")
    assert commits.count_changes(changes, path, "incidents", "status", "c") and not commits.count_changes(changes, path, "incidents", "status", "c")
    assert feeds.kept_cards(spark, path).first() == (0, 0, 3, 2)
    shown = {r.metric: (r.value, r.shown) for r in feeds.kept_metrics(spark, path, {"cases": "incidents", "none": "assets"}, 3).collect()}
    assert shown == {"incidents.open": (3, 3), "incidents.resolved": (2, 2), "cases.count": (5, 3), "none.count": (0, 0)}
    assert tables.read_table(spark, "incidents", f"{path}/incidents").count() == 5


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_pages_give_each_row_once_and_read_the_newest_days(spark, tmp_path, size):
    rows = [(f"a{k}", "low", k // 4) for k in range(30)] + [("a97", "low", None), ("a98", "low", None)]
    tables.write_facts({"alerts": alerts(spark, *rows)}, str(tmp_path))
    stored = commits.read_runs(spark, "alerts", str(tmp_path), "alert_id string, ts timestamp, event_date date")
    page = feeds.stored_page(stored, "ts", "alert_id", size)
    if size <= 3:
        assert len({r.event_date for r in page.select("event_date").distinct().collect()}) <= 2
        scan = page._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in scan and "2024-01-08" in scan and "2024-01-03" not in scan
    seen, after = [], None
    while (got := feeds.stored_page(stored, "ts", "alert_id", size, after).collect()) and len(seen) < 60:
        seen += [r.alert_id for r in got]
        after = (got[-1].ts, got[-1].alert_id)
        if size == 1 and len(seen) == 5:
            break
    want = [r.alert_id for r in feeds.latest_feed(stored, "ts", "alert_id", 100).collect()]
    assert seen == want[: len(seen)] and (size == 1 or len(seen) == 32)
