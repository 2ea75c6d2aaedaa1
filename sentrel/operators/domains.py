"""Domain feeds as common events: identity, endpoint, cloud, mail, and what analysts enter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import normalize_events, normalize_json


def feed(df: DataFrame, source_type: str, payload: dict[str, Column], event_id: str, ts: str) -> DataFrame:
    """A feed's rows as raw logs with an object payload, then normalised."""
    body = F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in payload.items()]))
    return normalize_json(df.select(F.col(event_id).cast("string").alias("event_id"), F.col(ts).alias("ts"), F.lit(source_type).alias("source_type"), F.lit(None).cast("long").alias("asset_id"), body.alias("payload")))


def iam_to_events(iam: DataFrame) -> DataFrame:
    odd = F.col("anomaly_score") >= 75
    return feed(iam, "iam", {
        "eventType": F.when(odd, "suspicious_login").otherwise("authentication_failed"), "eventCategory": F.lit("identity"),
        "message": F.concat("provider", F.lit(" "), "action", F.lit(" by "), "actor"), "sourceIp": F.col("source_ip"), "username": F.col("actor"),
        "severity": F.when(odd, "high").otherwise("medium"),
    }, "iam_event_id", "ts")


def endpoint_to_events(endpoint: DataFrame) -> DataFrame:
    shell = F.coalesce(F.lower("process_name").contains("powershell"), F.lit(False))
    return feed(endpoint, "endpoint", {
        "eventType": F.when(shell, "suspicious_powershell").otherwise("suspicious_process"), "eventCategory": F.lit("endpoint"),
        "message": F.concat(F.coalesce(F.nullif("process_name", F.lit("")), F.lit("process")), F.lit(" observed on "), "hostname"),
        "hostname": F.col("hostname"), "username": F.col("username"), "destinationIp": F.col("destination_ip"), "severity": F.col("severity"), "commandLine": F.col("command_line"),
    }, "telemetry_id", "ts")


def cloud_to_events(cloud: DataFrame) -> DataFrame:
    return feed(cloud, "cloud", {
        "eventType": F.lit("cloud_misconfiguration"), "eventCategory": F.lit("cloud"),
        "message": F.concat("provider", F.lit(" "), F.coalesce(F.nullif("service", F.lit("")), F.lit("resource")), F.lit(" finding: "), "finding_type"),
        "hostname": F.col("resource_id"), "severity": F.col("severity"),
    }, "finding_id", "ts")


def phishing_to_events(analyses: DataFrame, ts: str = "created_at") -> DataFrame:
    severity = F.when(F.col("verdict") == "malicious", "high").when(F.col("verdict") == "suspicious", "medium").otherwise("low")
    return feed(analyses, "phishing", {
        "eventType": F.lit("phishing_email"), "eventCategory": F.lit("email"), "message": F.concat("email_subject", F.lit(" from "), "sender"),
        "username": F.col("recipient"), "severity": severity,
    }, "analysis_id", ts)


def manual_events(entered: DataFrame) -> DataFrame:
    """Analysts' events pass unchanged, as source manual and status new."""
    return entered.withColumns({"source_type": F.lit("manual"), "status": F.lit("new")})


def unified_events(raw: DataFrame, *feeds: DataFrame) -> DataFrame:
    """Raw logs, normalised, and feeds that already are events, in one table (all rows)."""
    out = normalize_events(raw)
    for df in feeds:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
