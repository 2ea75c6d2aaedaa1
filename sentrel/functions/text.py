"""Column functions over messages: addresses, ports, severity and type by wording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns and wordings of the event model, first match wins.
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
SEVERITY_WORDS = (
    ("critical", "ransom|exfil|domain admin|critical|root compromise"),
    ("high", "malware|lateral|suspicious|powershell|privilege|high"),
    ("medium", "failed|denied|scan|warning|medium"),
)
TYPE_WORDS = (
    ("authentication_failed", "identity", "failed password|login failed|authentication failure|invalid user"),
    ("suspicious_powershell", "endpoint", "powershell|encodedcommand|invoke-webrequest"),
    ("privilege_escalation", "endpoint", "sudo|whoami /priv|setuid|privilege escalation"),
    ("port_scan", "network", "nmap|masscan|port scan|scan detected"),
    ("malware_detected", "endpoint", "c2|beacon|malware|trojan|ransomware"),
    ("lateral_movement", "network", "rlogin|psexec|smb session|winrm|lateral"),
    ("phishing_email", "email", "email|invoice|urgent action|verify your account"),
)
DEFAULT_TYPE = ("generic_security_event", "security")
SYSLOG = r"^(?:<\d+>)?(\w{3}\s+\d+\s+[\d:]+)?\s*([^\s]+)?\s*([^:]+)?:?\s*(.*)\z"
USER_BY_NAME = r"(?i)user(?:name)?[=:\s]+([\w.-]+)"
USER_BY_PHRASE = r"(?i)for\s+([\w.-]+)\s+from"


def or_null(c: Column) -> Column:
    """Empty strings as null."""
    return F.nullif(c, F.lit(""))


def extract_ips(text: Column) -> Column:
    """All IPv4-looking tokens in order, with repeats; octets aren't range-checked. Null gives null."""
    return F.regexp_extract_all(text, F.lit(IPV4), F.lit(0))


def extract_port(value: Column) -> Column:
    """A number, or null for null, blank-free empties and what is no plain finite number."""
    trimmed = F.trim(value.cast("string"))
    return F.when(trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), trimmed.try_cast("double").try_cast("int"))


def mentions(low: Column, words: str) -> Column:
    """Whether a lower-case text holds one of the words, which are parted by |."""
    return reduce(Column.__or__, [low.contains(w) for w in words.split("|")])


def infer_severity(message: Column, lowered: bool = False) -> Column:
    low = message if lowered else F.lower(message)
    return reduce(lambda c, w: c.when(mentions(low, w[1]), w[0]), SEVERITY_WORDS[1:], F.when(mentions(low, SEVERITY_WORDS[0][1]), SEVERITY_WORDS[0][0])).otherwise("low")


def infer_type(message: Column, lowered: bool = False) -> Column:
    """struct<event_type, event_category> of the first family whose words occur."""
    low = message if lowered else F.lower(message)
    made = lambda a, b: F.struct(F.lit(a).alias("event_type"), F.lit(b).alias("event_category"))
    out = F.when(mentions(low, TYPE_WORDS[0][2]), made(*TYPE_WORDS[0][:2]))
    for kind, category, words in TYPE_WORDS[1:]:
        out = out.when(mentions(low, words), made(kind, category))
    return out.otherwise(made(*DEFAULT_TYPE))
