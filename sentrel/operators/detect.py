"""From rule matches to detections, alerts, incidents and their audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import stable_id
from ..functions.text import or_null
from ..sources import commits
from ..sources.scratch import written
from ..sources.tables import write_facts
from .enrich import asset_lookup, ioc_values
from .normalize import normalize_events, spread
from .rules import CHUNK, Rule, evaluate_rules, marked

#: A match of this confidence, or of a critical rule, opens an incident; an analyst's detection of the other does.
AUTO, MANUAL = 85, 75


def incident_of(prefix: str = "") -> Column:
    opens = (F.col("match.confidence") >= AUTO) | F.coalesce(F.col("match.rule_severity") == "critical", F.lit(False))
    return F.when(opens, stable_id("event_id", "match.rule_id", F.lit("incident")))


def severity_of() -> Column:
    return F.coalesce("match.rule_severity", "severity", F.lit("medium"))


#: The wordings of titles, descriptions and actions below are fixed values.
def detections(matches: DataFrame) -> DataFrame:
    return matches.select(
        stable_id("event_id", "match.rule_id", F.lit("detection")).alias("detection_id"), F.col("match.rule_pk").alias("rule_id"), "event_id", "source_ip", "destination_ip",
        incident_of().alias("incident_id"), "match.confidence", F.col("match.reasons").alias("match_reasons"), "match.mitre_technique", "match.mitre_tactic", "ts",
    )


def alerts(matches: DataFrame) -> DataFrame:
    subject = F.coalesce(or_null(F.col("hostname")), or_null(F.col("source_ip")), F.col("event_type"))
    incident = incident_of()
    return matches.select(
        stable_id("event_id", "match.rule_id", F.lit("alert")).alias("alert_id"), F.concat("match.rule_name", F.lit(" matched on "), subject).alias("title"),
        F.array_join("match.reasons", "; ").alias("description"), severity_of().alias("severity"), "match.rule_id", "match.rule_name", F.array("event_id").alias("source_events"),
        F.when(incident.isNotNull(), "triaged").otherwise("new").alias("status"), incident.alias("incident_id"), F.to_json("match").alias("metadata"), "ts",
    )


def auto_incidents(matches: DataFrame) -> DataFrame:
    """One incident for each match that opens one; matches of one event and rule share an id."""
    return matches.where(incident_of().isNotNull()).select(
        incident_of().alias("incident_id"), F.concat(F.lit("Detection: "), "match.rule_name").alias("title"),
        F.concat(F.lit("Auto-created from ingestion pipeline for "), "event_type").alias("description"), severity_of().alias("severity"), F.lit("open").alias("status"),
        F.col("event_category").alias("classification"), F.when(F.col("asset").isNotNull(), F.array("asset.hostname")).alias("affected_assets"), F.col("ts").alias("detected_at"),
    )


def incident_audit(matches: DataFrame) -> DataFrame:
    return matches.where(incident_of().isNotNull()).select(
        incident_of().alias("incident_id"), F.lit("Auto-created from detection pipeline").alias("action"),
        F.to_json(F.struct(F.col("match.rule_name").alias("rule"), F.col("event_type").alias("eventType"))).alias("details"), "ts",
    )


def manual_detection_promote(entered: DataFrame) -> DataFrame:
    """Incidents that analysts' detections of confidence MANUAL or more open."""
    return entered.where(F.col("confidence") >= MANUAL).select(
        stable_id("detection_id", F.lit("incident")).alias("incident_id"), F.concat(F.lit("IDS Detection - Rule "), F.col("rule_id").cast("string")).alias("title"), F.lit("high").alias("severity"), F.lit("open").alias("status"), F.col("ts").alias("detected_at")
    )


def platform_audit(rows: DataFrame, actor: Column, action: str, entity_type: str, entity_id: Column, details: Column) -> DataFrame:
    """One audit row for each processed record."""
    return rows.select(stable_id(F.lit(action), entity_id).alias("audit_id"), actor.cast("long").alias("actor_user_id"), F.lit(action).alias("action"), F.lit(entity_type).alias("entity_type"), entity_id.cast("string").alias("entity_id"), F.lit("success").alias("outcome"), details.alias("details"))


def ingest_summary(events: DataFrame, matches: DataFrame) -> DataFrame:
    """(event_id, detections, alerts) for every event."""
    counts = matches.groupBy("event_id").count()
    return events.select("event_id").join(counts, "event_id", "left").select("event_id", F.coalesce("count", F.lit(0)).cast("long").alias("detections"), F.coalesce("count", F.lit(0)).cast("long").alias("alerts"))


def detect(events: DataFrame, assets: DataFrame, iocs: DataFrame, cves: DataFrame, rules: list[Rule], past: DataFrame | None = None) -> DataFrame:
    """Matches of events with their context; thresholds also count the earlier events in `past`.

    Events are written once (spark.checkpoint.dir), as counts, indicators and rules each read them. No rule reads CVEs
    or which indicators share a value, so `ioc_hits` are the values that were met; enrich_events gives the whole record of an event.
    """
    return evaluate(written(events, "events"), assets, iocs, rules, past)


def evaluate(events: DataFrame, assets: DataFrame, iocs: DataFrame, rules: list[Rule], past: DataFrame | None = None) -> DataFrame:
    """detect of events that are stored already. A few rules test the events' texts before any join, which then moves no text that the result doesn't need."""
    rows = marked(events, rules) if 0 < len(rules) <= CHUNK else events
    return evaluate_rules(ioc_values(asset_lookup(rows, assets), iocs, events), rules, past, events)


def outputs(matches: DataFrame) -> dict[str, DataFrame]:
    """The fact tables that follow from matches. Persist or write `matches` before taking several."""
    return {"ids_detections": detections(matches), "alerts": alerts(matches), "incidents": auto_incidents(matches), "incident_audit_trail": incident_audit(matches)}


def ingest(raw: DataFrame, assets: DataFrame, iocs: DataFrame, cves: DataFrame, rules: list[Rule]) -> DataFrame:
    """Raw logs to matches."""
    return detect(normalize_events(spread(raw)), assets, iocs, cves, rules)


def store(raw: DataFrame, assets: DataFrame, iocs: DataFrame, cves: DataFrame, rules: list[Rule], path: str, run: str | None = None) -> bool:
    """Raw logs through the job into the fact tables under `path`, as one committed run; events and matches are made once. False if the run is there already."""
    if run is not None and commits.is_committed(raw.sparkSession, path.rstrip("/"), run):
        return False
    own: list[str] = []
    try:
        events = written(normalize_events(spread(raw)), "events", own)
        matches = evaluate(events, assets, iocs, rules).drop("raw_log", "parsed_data")  # no fact of a match has them
        return write_facts({"security_events": events, **outputs(written(matches, "matches", own))}, path, run)
    finally:
        for folder in own:
            commits.remove(raw.sparkSession, folder)
