"""Mail triage by wording, sender, links and attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import stable_id

#: Patterns, points and limits of the score.
URLS = r"(?i)https?://[^\s)]+"
SENDER_NAMES, SENDER_DOMAINS = r"support-|secure-|verify-|alerts?@|billing@", r"\.ru|\.xyz|\.top|\.click"
URGENT = r"(?i)urgent|immediately|verify your account|password expires|invoice attached|wire transfer"
LURE = r"(?i)enable content|macro|docm|html attachment"
BASE, SENDER, WORDING, LINKS, ATTACHED, LURED = 35, 20, 15, 10, 10, 20
MALICIOUS, SUSPICIOUS, MOST = 75, 55, 95


def extract_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URLS), F.lit(0))


def suspicious_sender(sender: Column) -> Column:
    low = F.lower(sender)
    return F.coalesce(low.rlike(SENDER_NAMES) | low.rlike(SENDER_DOMAINS), F.lit(False))


def signals(mails: DataFrame) -> DataFrame:
    """Mails with the five signals. Null texts are empty, a null count is 0."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return mails.withColumns(
        {
            "urls": extract_urls(text("body")),
            "odd_sender": suspicious_sender(F.col("sender")),
            "urgent": F.concat(text("subject"), F.lit(" "), text("body")).rlike(URGENT),
            "attached": F.coalesce("attachment_count", F.lit(0)).cast("int"),
            "lure": text("body").rlike(LURE),
        }
    )


def phishing_score() -> Column:
    points = lambda test, n: F.when(test, n).otherwise(0)
    return F.lit(BASE) + points(F.col("odd_sender"), SENDER) + points(F.col("urgent"), WORDING) + points(F.size("urls") > 0, LINKS) + points(F.col("attached") > 0, ATTACHED) + points(F.col("lure"), LURED)


def phishing_verdict(score: Column) -> Column:
    return F.when(score >= MALICIOUS, "malicious").when(score >= SUSPICIOUS, "suspicious").otherwise("benign")


def phishing_reasons() -> Column:
    return F.filter(
        F.array(
            F.when(F.col("odd_sender"), "Sender profile matches known phishing naming patterns"),
            F.when(F.col("urgent"), "Urgency or coercion language detected"),
            F.when(F.size("urls") > 0, F.concat(F.lit("Email contains "), F.size("urls").cast("string"), F.lit(" URL(s)"))),
            F.when(F.col("attached") > 0, F.concat(F.lit("Email has "), F.col("attached").cast("string"), F.lit(" attachment(s)"))),
            F.when(F.col("lure"), "Attachment lure or macro execution wording present"),
        ),
        lambda r: r.isNotNull(),
    )


def phishing_indicators() -> Column:
    sender = F.when(F.col("odd_sender"), F.array(F.concat(F.lit("sender:"), "sender"))).otherwise(F.array().cast("array<string>"))
    return F.concat(sender, F.transform("urls", lambda u: F.concat(F.lit("url:"), u)))


def analyze(mails: DataFrame) -> DataFrame:
    """One analysis row a mail (mail_id, subject, sender, recipient, body, attachment_count)."""
    rows = signals(mails).withColumn("score", phishing_score())
    return rows.select(
        F.col("mail_id").cast("string").alias("analysis_id"), F.col("subject").alias("email_subject"), "sender", "recipient", F.size("urls").alias("url_count"), F.col("attached").alias("attachment_count"),
        phishing_verdict(F.col("score")).alias("verdict"), F.least("score", F.lit(MOST)).alias("confidence"), phishing_reasons().alias("reasons"), phishing_indicators().alias("indicators"), "score",
    )


def phishing_incidents(analyses: DataFrame) -> DataFrame:
    """Incidents of mails that aren't benign."""
    return analyses.where("verdict != 'benign'").select(
        stable_id("analysis_id", F.lit("incident")).alias("incident_id"), F.concat(F.lit("Phishing email triage: "), "email_subject").alias("title"),
        F.concat(F.lit("Auto-created from phishing analysis for sender "), "sender").alias("description"), F.when(F.col("verdict") == "malicious", "high").otherwise("medium").alias("severity"), F.lit("open").alias("status"), F.lit("phishing").alias("classification"),
    )
