"""Raw payloads to the common event schema, all in native column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

EVENT_COLUMNS = ["event_id", "ts", "source_type", "asset_id", "event_type", "event_category", "severity", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "hostname", "username", "raw_log", "parsed_data"]


def safe_json(payload: Column) -> Column:
    """A JSON object's text as it stands; other JSON as {"value": ...}; what is no JSON as {"message": ...}. Null gives null."""
    wrapped = F.when(F.ltrim(payload).startswith("{"), payload).otherwise(F.concat(F.lit('{"value":'), payload, F.lit("}")))
    return F.when(payload.isNotNull(), F.when(F.try_parse_json(payload).isNull(), F.to_json(F.struct(payload.alias("message")))).otherwise(wrapped))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """`rows` with further columns that are computed once a row: later filters and uses meet the values, not copies of their expressions."""
    return rows.select("*", F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


#: The fields of a JSON payload that the event model reads, and their aliases in order.
ALIASES = {
    "message": ("message", "log", "event"), "event_type": ("eventType",), "event_category": ("eventCategory", "category"), "severity": ("severity",),
    "source_ip": ("sourceIp", "src_ip"), "destination_ip": ("destinationIp", "dst_ip"), "source_port": ("sourcePort", "src_port"), "destination_port": ("destinationPort", "dst_port"),
    "protocol": ("protocol",), "hostname": ("hostname", "host"), "username": ("username", "user"),
}
BROKEN = "__broken"


def spread(logs: DataFrame) -> DataFrame:
    """`logs` dealt by event id: parsing is the dear step, and files may come in fewer or larger pieces than there are cores."""
    return logs.select("event_id", "ts", "source_type", "asset_id", "payload").repartition("event_id")


def normalize_events(logs: DataFrame) -> DataFrame:
    """Raw payloads as events, in one pass over the rows; what is no syslog source is read as JSON. A null payload is an empty message.

    Syslog lines are [<pri>][time] host app: message; a line that doesn't fit is its own message. Of JSON objects the
    known fields are read, each payload parsed once; everything else is a message. Addresses that no field gives come
    from message and payload. Other columns of `logs` are not read.
    """
    p, m = F.col("payload"), F.col("__m")
    syslog = F.coalesce((F.col("source_type") == "syslog") & p.isNotNull(), F.lit(False))
    fields = ", ".join(f"`{n}` string" for names in ALIASES.values() for n in names)
    bare = F.btrim(p, F.lit(" \t\r\n"))
    parsed = F.from_json(F.when(F.col("__object"), p), f"{fields}, `{BROKEN}` string", {"columnNameOfCorruptRecord": BROKEN})
    names = [n for own in ALIASES.values() for n in own]
    rows = once(logs.select("event_id", "ts", "source_type", "asset_id", "payload"), __syslog=syslog, __object=~syslog & F.coalesce(bare.startswith("{") & bare.endswith("}"), F.lit(False)))
    rows = rows.select("*", F.inline_outer(F.array(parsed)).alias(*[f"__j_{n}" for n in names], BROKEN))
    rows = rows.withColumn("__whole", F.col("__object") & F.col(BROKEN).isNull())
    field = lambda name: F.when(F.col("__whole"), F.coalesce(*[F.col(f"__j_{n}") for n in ALIASES[name]]))
    rows = once(rows, **{f"__g{k}": F.when(F.col("__syslog"), F.regexp_extract(p, T.SYSLOG, k)) for k in (2, 3, 4)})
    line = lambda k: T.or_null(F.col(f"__g{k}"))
    rows = once(rows, __m=F.when(F.col("__syslog"), F.coalesce(line(4), p)).otherwise(F.coalesce(field("message"), p, F.lit(""))), __p=F.when(~F.col("__syslog"), F.when(F.col("__whole"), p).otherwise(safe_json(p))), __src=field("source_ip"), __dst=field("destination_ip"), __host=F.coalesce(line(2), field("hostname")))
    searched = F.when(F.col("__syslog"), m).otherwise(F.concat_ws(" ", m, "__p"))
    rows = once(rows, __low=F.lower(m), __ips=F.when(F.col("__src").isNull() | F.col("__dst").isNull(), T.extract_ips(searched)))
    rows = once(rows, __t=T.infer_type(F.col("__low"), lowered=True), __u1=F.when(F.col("__syslog"), F.regexp_extract(m, T.USER_BY_NAME, 1)))
    rows = once(rows, __u2=F.when(F.col("__u1") == "", F.regexp_extract(m, T.USER_BY_PHRASE, 1)))
    stated = F.to_json(F.struct(F.col("__host").alias("syslogHost"), line(3).alias("syslogApp"), m.alias("message")))
    return rows.select(
        "event_id", "ts", "source_type", "asset_id",
        F.coalesce(field("event_type"), F.col("__t.event_type")).alias("event_type"),
        F.coalesce(field("event_category"), F.col("__t.event_category")).alias("event_category"),
        F.coalesce(field("severity"), T.infer_severity(F.col("__low"), lowered=True)).alias("severity"),
        F.coalesce(F.col("__src"), F.get("__ips", F.lit(0))).alias("source_ip"),
        F.coalesce(F.col("__dst"), F.get("__ips", F.lit(1))).alias("destination_ip"),
        T.extract_port(field("source_port")).alias("source_port"), T.extract_port(field("destination_port")).alias("destination_port"),
        field("protocol").alias("protocol"), F.col("__host").alias("hostname"),
        F.when(F.col("__syslog"), F.coalesce(T.or_null(F.col("__u1")), T.or_null(F.col("__u2")))).otherwise(field("username")).alias("username"),
        p.alias("raw_log"), F.when(F.col("__syslog"), stated).otherwise(F.col("__p")).alias("parsed_data"),
    )


def normalize_syslog(logs: DataFrame) -> DataFrame:
    """The syslog lines of `logs` as events."""
    return normalize_events(logs.where("source_type = 'syslog'"))


def normalize_json(logs: DataFrame) -> DataFrame:
    """All other payloads of `logs` as events."""
    return normalize_events(logs.where("source_type is null or source_type != 'syslog'"))


def dedupe_event_id(events: DataFrame, within: str | None = None) -> DataFrame:
    """One row an event id; on a stream, within the watermark's delay when `within` is given."""
    if events.isStreaming:
        return (events.withWatermark("ts", within) if within else events).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
