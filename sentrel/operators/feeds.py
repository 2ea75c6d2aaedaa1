"""Threat intelligence look-ups, newest-first feeds and dashboard aggregates."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import or_null
from ..sources import commits

#: The partition of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def latest_feed(rows: DataFrame, order: str, tie: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """The newest rows; nulls last, ties by id. For deep pages filter `order` below the last page's end rather than raise the offset."""
    return rows.orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc()).offset(offset).limit(limit)


def stored_page(rows: DataFrame, order: str, tie: str, limit: int = 100, after: tuple | None = None, day: str = "event_date") -> DataFrame:
    """The newest rows of a stored table that is partitioned by the day of `order`: only as many of the newest days are read as fill the page.

    `after` is the (order, tie) of the last page's last row, and this page is what follows it, so that no page reads the
    earlier ones. Rows without a time come last. Days are known from the names of the files; twice as many are
    looked at each time a page isn't full.
    """
    found = {m[1] for f in rows.inputFiles() if (m := re.search(rf"/{day}=([^/]+)/", f))}
    dated, undated = sorted(found - {NO_DAY}, reverse=True), found & {NO_DAY}
    if after is not None:
        at, last = after
        rows = rows.where(F.col(order).isNull() & (F.col(tie) < last) if at is None else F.col(order).isNull() | (F.col(order) < F.lit(at)) | ((F.col(order) == F.lit(at)) & (F.col(tie) < last)))
        latest = None if at is None else str(at + dt.timedelta(days=1))[:10]  # dates here are the driver's, days the session's
        dated = [d for d in dated if at is not None and d <= latest]
    size = 1
    while True:
        own = rows.where(F.col(day).isin(*dated[:size])) if dated[:size] else rows.where("false")
        if size > len(dated):
            return latest_feed(own.unionByName(rows.where(F.col(day).isNull())) if undated else own, order, tie, limit)
        if own.limit(limit).count() >= limit:
            return latest_feed(own, order, tie, limit)
        size *= 2


def search_ioc(iocs: DataFrame, value: str) -> DataFrame:
    """Indicators whose value holds `value` in any case; % and _ in it are wildcards."""
    return iocs.where(F.lower("ioc_value").like(f"%{value.lower()}%"))


def list_iocs(iocs: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return latest_feed(iocs, "created_at", "id", limit, offset)


def list_cves(cves: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return latest_feed(cves, "published_date", "cve_id", limit, offset)


def cve_by_id(cves: DataFrame, cve_id: str) -> DataFrame:
    return cves.where(F.lower("cve_id") == cve_id.lower())


def top_threat_actors(actors: DataFrame, limit: int = 20) -> DataFrame:
    return latest_feed(actors, "known_incidents", "id", limit)


def list_honeypots(honeypots: DataFrame, interactions: DataFrame) -> DataFrame:
    """Honeypots with the number of their interactions, which is counted."""
    counts = interactions.groupBy("honeypot_id").agg(F.count("*").alias("n"))
    return honeypots.drop("interaction_count").join(counts, F.col("id") == F.col("honeypot_id"), "left").withColumn("interaction_count", F.coalesce("n", F.lit(0))).drop("n", "honeypot_id")


def newest_per(rows: DataFrame, key: str, order: str, tie: str, k: int) -> DataFrame:
    """The k newest rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(tie).desc()))).where(F.col("rank") <= k)


def honeypot_interactions(rows: DataFrame, k: int = 100) -> DataFrame:
    return newest_per(rows, "honeypot_id", "ts", "interaction_id", k)


def attacker_history(rows: DataFrame, ip: str) -> DataFrame:
    return rows.where(F.lower("attacker_ip") == ip.lower()).orderBy(F.col("ts").desc())


def attacker_summary(rows: DataFrame) -> DataFrame:
    """Each attacker's first and last time and number of interactions."""
    return rows.groupBy("attacker_ip").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("interactions"))


def events_by_severity(events: DataFrame, severity: str, limit: int = 100) -> DataFrame:
    return latest_feed(events.where(F.col("severity") == severity), "ts", "event_id", limit)


def recent_events(events: DataFrame, limit: int = 300) -> DataFrame:
    return latest_feed(events, "ts", "event_id", limit)


def alert_stats(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").count()


def incident_stats(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("status").count()


def dashboard_metrics(alerts: DataFrame, incidents: DataFrame, counted: dict[str, DataFrame], page: int = 10) -> DataFrame:
    """(metric, value, shown): counts by severity and status, and of each table in `counted`; `shown` saturates at `page` for the latter."""
    parts = [
        alerts.groupBy("severity").count().select(F.concat(F.lit("alerts."), "severity").alias("metric"), F.col("count").alias("value"), F.col("count").alias("shown")),
        incidents.groupBy("status").count().select(F.concat(F.lit("incidents."), "status").alias("metric"), F.col("count").alias("value"), F.col("count").alias("shown")),
    ]
    parts += [df.agg(F.count("*").alias("value")).select(F.lit(f"{name}.count").alias("metric"), "value", F.least("value", F.lit(page).cast("long")).alias("shown")) for name, df in counted.items()]
    return reduce(DataFrame.unionByName, parts)


def kept_metrics(spark: SparkSession, path: str, counted: dict[str, str], page: int = 10) -> DataFrame:
    """What dashboard_metrics gives, from the counts that the commits under `path` keep: no fact is read. `counted` has the table of each shown name."""
    kept = commits.counts(spark, path)
    rows = [(f"{table}.{key.partition('=')[2]}", n, n) for table, column in (("alerts", "severity"), ("incidents", "status")) for key, n in kept.get(table, {}).items() if key.startswith(f"{column}=") and n]
    rows += [(f"{name}.count", n, min(n, page)) for name, table in counted.items() for n in [kept.get(table, {}).get("", 0)]]
    return spark.createDataFrame(sorted(rows), "metric string, value long, shown long")


def kept_cards(spark: SparkSession, path: str) -> DataFrame:
    """What kpi_cards gives, from kept counts."""
    kept = commits.counts(spark, path)
    of = lambda table, key: kept.get(table, {}).get(key, 0)
    row = (of("alerts", "severity=critical"), of("alerts", "severity=high"), of("incidents", "status=open"), of("incidents", "status=resolved"))
    return spark.createDataFrame([row], "critical_alerts long, high_alerts long, open_incidents long, resolved_incidents long")


def kpi_cards(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row: critical and high alerts, open and resolved incidents."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    a = alerts.agg(count("severity", "critical").alias("critical_alerts"), count("severity", "high").alias("high_alerts"))
    b = incidents.agg(count("status", "open").alias("open_incidents"), count("status", "resolved").alias("resolved_incidents"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(a).join(one(b), "__one").drop("__one")


def feed_label() -> Column:
    return F.coalesce(or_null(F.col("hostname")), F.col("source_ip"))


def event_feed(events: DataFrame, limit: int = 50) -> DataFrame:
    return recent_events(events, limit).withColumn("label", feed_label())
