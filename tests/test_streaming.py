"""The stream gives what the batch gives."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from sentrel.operators import detect, normalize, rules
from sentrel.plans import catalog
from sentrel.sources import tables
from sentrel.streaming.detect import Counter, stream_detect, stream_threshold

from test_golden import scenario

T0 = dt.datetime(2024, 1, 1)


def test_stream_detect_matches_batch(spark, tmp_path):
    raw, assets, iocs, cves, loaded = scenario(spark, "web-01")
    raw.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(raw.schema).parquet(f"{tmp_path}/in")
    query = stream_detect(source, assets, iocs, cves, loaded, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    want = {r.alert_id for r in detect.alerts(detect.ingest(raw, assets, iocs, cves, loaded)).collect()}
    got = {r.alert_id for r in tables.read_table(spark, "alerts", f"{tmp_path}/out/alerts").collect()}
    assert got == want and len(want) == 1
    assert tables.read_table(spark, "security_events", f"{tmp_path}/out/security_events").count() == 3


def fed(spark, tmp_path, *parts):
    """The parts as a stream of one batch each."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_threshold_matches_batch_with_late_events(spark, tmp_path):
    rows = [(f"e{i:03}", T0 + dt.timedelta(minutes=i * 4), f"u{i % 3}" if i % 7 else None) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id string, ts timestamp, username string")
    late = "event_id in ('e020', 'e021', 'e022', 'e025')"  # up to 40 minutes behind the batch before
    end = spark.createDataFrame([("end", T0 + dt.timedelta(days=2), "nobody")], events.schema)
    source = fed(spark, tmp_path, events.where(f"event_id < 'e030' and not {late}"), events.where(f"event_id >= 'e030' or {late}"), end)
    query = stream_threshold(source, "username", 30, "1 hour").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    got = {r.event_id: r.n for r in spark.table("counts").collect() if r.event_id != "end"}
    want = {r.event_id: r.n for r in rules.threshold_window(events, "username", 30, "n").where(F.col("username").isNotNull()).collect()}
    assert got == want


class Kept:
    """A map of state that notes how much is written to it."""

    def __init__(self):
        self.held, self.written = {}, 0

    def updateValue(self, key, value):
        self.held[key] = value
        self.written += len(value[0]) if isinstance(value[0], list) else 1

    def getValue(self, key):
        return self.held[key]

    def containsKey(self, key):
        return key in self.held

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return iter(list(self.held))

    def iterator(self):
        return iter(list(self.held.items()))


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Kept())

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_state_written_follows_what_is_new():
    """One key, 200 batches of 50 events in a window that holds 6400: a batch writes its own events and one part of the window, not the window."""
    draw = random.Random(3)
    handle, counter = Handle(), Counter(128 * 60_000_000)
    counter.init(handle)
    got, rows, sent = {}, [], []
    for batch in range(200):
        own = [(batch * 60_000_000 + draw.randrange(60_000_000), f"{batch}-{i}") for i in range(50)]
        rows += own
        frame = pd.DataFrame({"event_id": [i for _, i in own], "ts": pd.to_datetime([at for at, _ in own], unit="us")})
        before = sum(m.written for m in handle.maps.values())
        for out in counter.handleInputRows(("k",), iter([frame]), Clock((batch - 5) * 60_000)):
            got |= dict(zip(out["event_id"], out["n"], strict=True))
        sent.append(sum(m.written for m in handle.maps.values()) - before)
    assert max(sent) <= 600 and len(handle.timers) == 1
    width, rows = 128 * 60_000_000, sorted(rows)
    assert len(got) > 9000 and all(got[i] == sum(at - width <= t and (t, j) <= (at, i) for t, j in rows) for at, i in rows[::97] if i in got)
    assert len(handle.maps["sizes"].held) <= 70
    list(counter.handleExpiredTimer(("k",), Clock(10**9), None))
    assert not any(m.held for m in handle.maps.values()) and not handle.timers


class Noted(Kept):
    """A map of state that counts its uses."""

    uses = 0

    def __getattribute__(self, name):
        Noted.uses += name in ("updateValue", "getValue", "containsKey", "removeKey", "keys", "iterator")
        return super().__getattribute__(name)


def test_uses_of_state_do_not_follow_events():
    """One key, 2000 events over as many parts of the window in one batch: a use of state is a message, so it is made for lots and for the parts that stay."""
    handle, counter = Handle(), Counter(64 * 60_000_000)
    handle.maps = {name: Noted() for name in ("waiting", "times", "sizes")}
    counter.init(handle)
    rows = [(i * 60_000_000, f"e{i:04}") for i in range(2000)]
    frame = pd.DataFrame({"event_id": [i for _, i in rows], "ts": pd.to_datetime([at for at, _ in rows], unit="us")})
    got = [n for out in counter.handleInputRows(("k",), iter([frame]), Clock(0)) for n in out["n"]]
    got += [n for out in counter.handleExpiredTimer(("k",), Clock(10**9), None) for n in out["n"]]
    assert Noted.uses < 40 and got == [min(i + 1, 65) for i in range(2000)] and not any(m.held for m in handle.maps.values())


def test_delayed_batches_hold_each_event_once(spark):
    """However the span is rounded when it is parted."""
    for micros in (0, 1, 2):
        events = spark.range(3000).selectExpr("cast(id as string) as event_id", "'u' as username", f"timestamp_micros(cast(if(id > 2989, 9000000000 + {micros} - (2999 - id) div 5, id * 3000000) as long)) as ts")
        ids = [r.event_id for own in catalog.delayed(events) for r in own.collect() if r.event_id != "end"]
        assert sorted(ids, key=int) == [str(i) for i in range(3000)]


def test_thresholds_look_back_over_batches_and_replays_write_once(spark, tmp_path):
    raw, assets, iocs, cves, loaded = scenario(spark, "web-01")
    parts = [raw.where(f"event_id = 'e{k}'") for k in range(3)]
    source = fed(spark, tmp_path, *parts)
    query = stream_detect(source, assets, iocs, cves, loaded, f"{tmp_path}/out", f"{tmp_path}/cp")
    query.processAllAvailable()
    query.stop()
    want = {r.alert_id for r in detect.alerts(detect.ingest(raw, assets, iocs, cves, loaded)).collect()}
    read = lambda name: tables.read_table(spark, name, f"{tmp_path}/out/{name}")
    assert len(want) == 1 and {r.alert_id for r in read("alerts").collect()} == want  # the third login in the third batch
    assert read("security_events").where("enrichment like '%assetContext%' or enrichment like '%asset_context%'").count() == 3
    again = stream_detect(source, assets, iocs, cves, loaded, f"{tmp_path}/out", f"{tmp_path}/cp2", once=True)  # a lost checkpoint: all batches come again
    again.awaitTermination()
    assert read("security_events").count() == 3 and read("alerts").count() == 1


def test_stream_dedupe(spark, tmp_path):
    rows = spark.createDataFrame([("a", T0), ("a", T0), ("b", T0)], "event_id string, ts timestamp")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = normalize.dedupe_event_id(source, "1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("once").count() == 2


def logs_of(spark, *rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(hours=h), "raw", None, text) for i, h, text in rows], "event_id string, ts timestamp, source_type string, asset_id long, payload string")


def test_batches_store_each_event_once_and_late_ones_too(spark, tmp_path):
    _, assets, iocs, cves, loaded = scenario(spark, "web-01")
    first = logs_of(spark, ("a", 10, "later"), ("a", 9, "earlier"), ("b", 20, "one"))
    second = logs_of(spark, ("b", 20, "again"), ("b", 20.5, "within the delay"), ("late", 1, "nineteen hours behind"), ("c", 21, "new"))
    for rows in (first, second):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream_detect(source, assets, iocs, cves, loaded, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination()
    stored = tables.read_table(spark, "security_events", f"{tmp_path}/out/security_events")
    assert sorted((r.event_id, r.raw_log) for r in stored.collect()) == [("a", "earlier"), ("b", "one"), ("c", "new"), ("late", "nineteen hours behind")]


def test_a_feed_in_batches_is_written_by_many_tasks(spark, sf_dir):
    """Each batch has as many files as are read at once, and rows without a time come last."""
    start = F.timestamp_seconds(F.lit(1704067200))
    rows = spark.range(40_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 1000 > 0, start + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int") % 5000)).alias("ts"))
    feed = catalog.streamed(catalog.Data(spark, sf_dir), rows, "feed", 4)
    assert feed.isStreaming
    seen, files = [], []

    def note(batch, number):
        held = batch.select("ts", F.input_file_name().alias("file")).collect()
        files.append(len({r.file for r in held}))
        seen.append(([r.ts for r in held if r.ts], len(held)))

    feed.writeStream.foreachBatch(note).trigger(availableNow=True).start().awaitTermination()
    assert len(set(files)) == 1 and files[0] > 1 and len(files) == 4 and sum(n for _, n in seen) == 40_000
    assert all(max(before) < min(after) for (before, _), (after, _) in zip(seen, seen[1:]))
    assert seen[3][1] - len(seen[3][0]) == 40


def test_events_do_not_move_for_the_cves_of_assets(spark):
    from sentrel.operators import enrich

    raw, assets, iocs, cves, _ = scenario(spark, "web-01")
    plan = enrich.enrich_events(normalize.normalize_events(raw), assets, iocs, cves)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(asset#" not in plan and "hashpartitioning(event_id#" in plan
