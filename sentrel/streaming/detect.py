"""The detection job on unbounded feeds."""

from __future__ import annotations

import datetime as dt
import json
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.detect import outputs
from ..operators.enrich import asset_cves, asset_lookup, enrich_events, hits_of, with_hits
from ..operators.normalize import normalize_events, spread
from ..operators.rules import CHUNK, Rule, evaluate_rules, marked, thresholds_of
from ..sources import commits
from ..sources.schemas import TABLES
from ..sources.scratch import written
from ..sources.tables import write_facts


def batch_events(batch: DataFrame) -> DataFrame:
    """Normalised events of a batch of raw logs, the earliest of each id: rows are dealt by id for that, and parsed in all tasks after it."""
    same = Window.partitionBy("event_id").orderBy(F.col("ts").asc_nulls_last())
    rows = spread(batch).withColumn("__again", F.lag(F.lit(True)).over(same))
    return normalize_events(rows.where("__again is null"))


#: A key's times are kept in so many parts of the window, of which a batch rewrites only those that it adds to.
PARTS = 64
#: Events that wait are kept in lots of up to so many, of which a batch reads those that the watermark has reached.
LOT = 512
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Counter(StatefulProcessor):
    """Counts the events of a key in the window before each one, once the watermark has reached it.

    State is three maps: lots of events that wait, by their first place, and by part of the window times that have been
    counted, and how many these are. A count adds up the sizes of the parts inside the window and looks into the one
    that it begins in, so neither what is read nor what is written grows with the events of the window, but for that
    part and the lot that the watermark is in. Each use of state is a message to the JVM, so a key's uses in a batch
    grow with its lots and the parts that stay, not with its events.
    """

    def __init__(self, width: int):
        self.width, self.part = width, max(1, width // PARTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, number long", "ids array<string>, places array<long>")
        self.times = handle.getMapState("times", "part long", "places array<long>")
        self.sizes = handle.getMapState("sizes", "part long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple[int, str]] = []
        for frame in rows:
            places = pd.to_datetime(frame["ts"]).astype("datetime64[us]").astype("int64").tolist()
            new += zip(places, frame["event_id"].tolist(), strict=True)
        yield from self.released(key, timerValues, new)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.released(key, timerValues, [])

    def split(self, new: list[tuple[int, str]], reached: int) -> tuple[list[tuple[int, str]], int | None]:
        """What the watermark has reached of the new events and of those that waited, in order, and the first place that still waits. The rest is kept in lots."""
        lots, events = sorted(self.waiting.keys()), list(new)
        begun = [lot for lot in lots if lot[0] <= reached]
        for lot in begun:
            ids, places = self.waiting.getValue(lot)
            events += zip(places, ids, strict=True)
            self.waiting.removeKey(lot)
        events.sort()
        ready = bisect_right(events, reached, key=lambda e: e[0])
        later, left = events[ready:], set(lots[len(begun) :])
        for k in range(0, len(later), LOT):
            lot, number = later[k : k + LOT], 0
            while (lot[0][0], number) in left:
                number += 1
            left.add((lot[0][0], number))
            self.waiting.updateValue((lot[0][0], number), ([e for _, e in lot], [at for at, _ in lot]))
        return events[:ready], min(left)[0] if left else None

    def released(self, key: tuple, timerValues: TimerValues, new: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        """The counts of what the watermark has reached; the rest waits for a timer."""
        reached = timerValues.getCurrentWatermarkInMs() * 1000 + 999  # the watermark is cut to milliseconds
        events, first = self.split(new, reached)
        sizes = {p[0]: n[0] for p, n in self.sizes.iterator()}
        stored, held = set(sizes), {}

        def times(part: int) -> list[int]:
            if part not in held:
                held[part] = list(self.times.getValue((part,))[0]) if part in stored else []
            return held[part]

        out, changed = [], set()
        # events come in order, so the parts that a count adds up move forward: those of `parts` from `low` to `high`
        parts, low, high, inside = sorted(sizes), 0, 0, 0
        for at, event_id in events:
            own, begins = at // self.part, (at - self.width) // self.part
            if own not in sizes:
                sizes[own] = 0
                insort(parts, own)
            while high < len(parts) and parts[high] <= own:
                inside += sizes[parts[high]]
                high += 1
            while low < high and parts[low] <= begins:
                inside -= sizes[parts[low]]
                low += 1
            insort(times(own), at)
            sizes[own] += 1
            inside += 1
            changed.add(own)
            earlier = times(begins)
            out.append((event_id, key[0], pd.Timestamp(at, unit="us"), len(earlier) - bisect_left(earlier, at - self.width) + inside))
        for part in list(sizes):
            if (part + 1) * self.part <= reached - self.width:  # no later event counts these
                sizes.pop(part)
                changed.discard(part)
                if part in stored:
                    self.times.removeKey((part,))
                    self.sizes.removeKey((part,))
        for part in changed:
            self.times.updateValue((part,), (held[part],))
            self.sizes.updateValue((part,), (sizes[part],))
        due = first if first is not None else (max(sizes) + 1) * self.part + self.width if sizes else None
        timers = list(self.handle.listTimers())
        wanted = [] if due is None else [max(due // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)]
        for timer in set(timers) - set(wanted):
            self.handle.deleteTimer(timer)
        for timer in set(wanted) - set(timers):
            self.handle.registerTimer(timer)
        if out:
            yield pd.DataFrame(out, columns=["event_id", "key", "ts", "n"])

    def close(self) -> None:
        pass


def stream_threshold(events: DataFrame, key: str, minutes: int, delay: str = "1 hour") -> DataFrame:
    """(event_id, key, ts, n): events of the same key in the window before each one, and itself, as threshold_window counts them.

    An event is counted once the watermark has reached it, so events that come late by up to `delay` count and are
    counted exactly as in a batch. State ends when nothing waits and no time is in the window any more. Null and
    empty keys are left out: their count is 1. State is kept in RocksDB, which the session is set to where it still has
    the default store, as that is the only one that holds maps and timers.
    """
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBacked" in (conf.get(name, None) or "HDFSBacked"):
        conf.set(name, ROCKS)
    keyed = events.where(f"{key} is not null and {key} != ''").select("event_id", F.col(key).alias("key"), "ts").withWatermark("ts", delay)
    return keyed.groupBy("key").transformWithStateInPandas(Counter(minutes * 60_000_000), "event_id string, key string, ts timestamp, n long", "Append", "EventTime")


def earlier(batch: DataFrame, stored: DataFrame, rules: list[Rule]) -> DataFrame | None:
    """(event_id, ts, source_ip, username) of the stored events that thresholds of this batch look back to: those of its keys and other ids, from its first time less the longest window on."""
    wanted = thresholds_of(rules)
    span = batch.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    if not wanted or span.first is None:
        return None
    first = span.first - dt.timedelta(minutes=max(minutes for _, minutes in wanted))
    near = stored.where((F.col("ts") >= F.lit(first)) & (F.col("ts") <= F.lit(span.last)))
    if "event_date" in stored.columns:
        day = dt.timedelta(days=1)  # days are those of the session's zone, dates here of the driver's
        near = near.where((F.col("event_date") >= F.lit(first.date() - day)) & (F.col("event_date") <= F.lit(span.last.date() + day)))
    near = near.select("event_id", "ts", "source_ip", "username").join(batch.select("event_id"), "event_id", "left_anti")
    own = [near.join(batch.select(key).where(f"{key} != ''").distinct(), key, "left_semi").select("event_id", "ts", "source_ip", "username") for key in sorted({key for key, _ in wanted})]
    return own[0] if len(own) == 1 else own[0].unionByName(own[1])


def stored_events(spark, path: str, first: dt.datetime, last: dt.datetime) -> DataFrame:
    """The committed security events under `path` of runs that have some between two times, with their day."""
    day = dt.timedelta(days=1)  # commits have times in the session's zone, dates here are the driver's
    return commits.read_runs(spark, "security_events", path, f"{TABLES['security_events']}, event_date date", first=str(first - day), last=str(last + day))


def query_id(spark, checkpoint: str) -> str:
    """The id that a stream keeps over restarts, from its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first().value)["id"]


def in_span(rows: DataFrame, first: dt.datetime, last: dt.datetime) -> DataFrame:
    """Rows of stored events between two times, of the days around them."""
    day = dt.timedelta(days=1)  # days are those of the session's zone, dates here of the driver's
    return rows.where(F.col("event_date").between(F.lit(first.date() - day), F.lit(last.date() + day)) & F.col("ts").between(F.lit(first), F.lit(last)))


#: What facts take from the event of a match.
OF_EVENT = ["event_id", "ts", "source_ip", "destination_ip", "hostname", "event_type", "event_category", "severity"]


def stream_detect(raw: DataFrame, assets: DataFrame, iocs: DataFrame, cves: DataFrame, rules: list[Rule], path: str, checkpoint: str, history: Callable[[], DataFrame | None] | None = None, delay: str = "1 hour", once: bool = False) -> StreamingQuery:
    """Each micro-batch of a raw stream through the batch job into the fact tables under `path`, as one committed run of this query and batch: a replayed batch writes once.

    Other streams and batches may write to the same tables. Events whose id is stored already, with a time in the
    batch's span or up to `delay` beside it, are left out: a stream that begins anew with a fresh checkpoint adds only
    what is new, and nothing is dropped for being late. No state is kept for that but what is stored. Thresholds look back
    over stored events besides the batch itself: those under `path`, or what `history()` returns. Of these only id,
    time and keys are read, of the batch's span and the longest window before it. `once` reads what there is and stops;
    the CVEs of assets are then found once and kept in the folder in `spark.checkpoint.dir`, not found in each batch.
    """
    spark = raw.sparkSession
    back = dt.timedelta(minutes=max([0, *(minutes for _, minutes in thresholds_of(rules))]))
    found: list[DataFrame] = []  # the CVEs of assets, where they are found once for all batches
    slim = assets.drop("services")
    beside = spark.sql(f"select cast(interval {delay} as interval day to second) as d").first().d

    def work(batch: DataFrame, number: int) -> None:
        run = f"{query_id(spark, checkpoint)}-{number:09}"
        if commits.is_committed(spark, path, run):
            return
        paths: list[str] = []
        # a stream's session plans without sizes, so each step and each day's files would have all its shuffle partitions
        conf, name = batch.sparkSession.conf, "spark.sql.adaptive.enabled"
        before = conf.get(name)
        conf.set(name, "true")
        try:
            own = written(batch_events(batch), "span", paths)
            ends = own.agg(F.count("*").alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")).first()
            if not ends.rows:
                return
            stored = None if ends.first is None else stored_events(spark, path, ends.first - max(back, beside), ends.last + beside)
            if stored is not None:
                again = in_span(stored, ends.first - beside, ends.last + beside).select("event_id")
                if not own.join(again, "event_id", "left_semi").isEmpty():
                    own = written(own.join(again, "event_id", "left_anti"), "fresh", paths)
            context = history() if history is not None else stored
            past = None if context is None else earlier(own, context, rules)
            past = past if past is None else written(past, "past", paths)
            if once and not found:
                found.append(written(asset_cves(assets, cves), "cves"))
            hits = written(hits_of(own, iocs), "hits", paths)
            known = enrich_events(own, slim, iocs, cves, found[0] if found else asset_cves(assets, cves), hits)
            # a few rules test the texts first, which the joins then don't move
            rows = marked(own, rules) if 0 < len(rules) <= CHUNK else own
            rows = with_hits(asset_lookup(rows, assets.select("id", "hostname", "ip_address", "criticality")), hits.select("event_id", F.col("ioc_hits.value").alias("ioc_hits")))
            matches = written(evaluate_rules(rows, rules, past, own).select(*OF_EVENT, "asset", "match"), "matches", paths)
            write_facts({"security_events": known.withColumn("enrichment", F.to_json("enrichment")), **outputs(matches)}, path, run)
        finally:
            for folder in paths:
                commits.remove(spark, folder)
            conf.set(name, before)

    writer = raw.select("event_id", "ts", "source_type", "asset_id", "payload").writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
