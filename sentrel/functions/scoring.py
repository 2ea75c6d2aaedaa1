"""Column functions for weights, severities and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of an event's severity and of a finding's, and the technique of each event type.
SEVERITY_WEIGHT = {"critical": 35, "high": 25, "medium": 15}
RISK = {"critical": 9, "high": 6, "medium": 3}
MITRE = {
    "authentication_failed": ("T1110", "Credential Access"),
    "brute_force": ("T1110", "Credential Access"),
    "suspicious_powershell": ("T1059.001", "Execution"),
    "suspicious_process": ("T1059", "Execution"),
    "privilege_escalation": ("T1068", "Privilege Escalation"),
    "port_scan": ("T1046", "Discovery"),
    "malware_detected": ("T1105", "Command and Control"),
    "lateral_movement": ("T1021", "Lateral Movement"),
    "phishing_email": ("T1566", "Initial Access"),
    "suspicious_login": ("T1078", "Defense Evasion"),
}


def by_value(c: Column, values: dict[str, object], default: object) -> Column:
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(c == k, v)
    return out.otherwise(default)


def severity_weight(severity: Column) -> Column:
    return by_value(severity, SEVERITY_WEIGHT, 5)


def mitre_lookup(event_type: Column) -> Column:
    """struct<technique, tactic>, or null."""
    out = None
    for kind, (technique, tactic) in MITRE.items():
        out = (F if out is None else out).when(event_type == kind, F.struct(F.lit(technique).alias("technique"), F.lit(tactic).alias("tactic")))
    return out


def cvss_severity(score: Column) -> Column:
    """9 and more is critical, 7 high, 4 medium, else low; no score counts as 5."""
    s = F.coalesce(score.cast("double"), F.lit(5.0))
    return F.when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").otherwise("low")


def risk_of(severity: Column) -> Column:
    return by_value(severity, RISK, 1)


def content_hashes(text: Column) -> dict[str, Column]:
    """Digests of the UTF-8 text, by the evidence table's columns."""
    return {"md5_hash": F.md5(text.cast("binary")), "sha1_hash": F.sha1(text.cast("binary")), "sha256_hash": F.sha2(text.cast("binary"), 256), "sha512_hash": F.sha2(text.cast("binary"), 512)}


def stable_id(*parts: Column | str) -> Column:
    """A deterministic id of what it is made from, so reruns write the same rows."""
    return F.sha2(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256)
