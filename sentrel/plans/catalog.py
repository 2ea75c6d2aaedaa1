"""The registered queries of the security operators, each with the SQL that it is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net, scoring
from ..functions import text as T
from ..operators import cases, detect, domains, enrich, feeds, normalize, phishing, rules, search, vuln
from ..sources import commits, merge, tables
from ..sources.scratch import scratch_path
from ..streaming import detect as detect_stream
from .fixtures import Data, Spelling, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DUCK = Spelling(True)


def query(sql: str | None = None, more: dict[str, str] | None = None, name: str | None = None):
    """Register a function of Data as a query under its own name, with its SQL."""

    def put(of: Callable[[Data], DataFrame]):
        key = name or of.__name__
        QUERIES[key] = lambda spark, sf_dir: of(Data(spark, sf_dir))
        if sql is not None:
            SQL[key] = duck(sql, more)
        return of

    return put


def bar(c) -> F.Column:
    """An array of strings as one text."""
    return F.array_join(c, "|")


# ---- what the SQL side shares -------------------------------------------------------------------------------------

# The SQL states the event model's fixed values in its own words, so that it doesn't follow the library's constants.
SYSLOG = r"^(?:<\d+>)?(\w{3}\s+\d+\s+[\d:]+)?\s*([^\s]+)?\s*([^:]+)?:?\s*(.*)$"
words = lambda c, w: f"regexp_matches(lower({c}), '{w}')"


def severity_sql(c: str) -> str:
    critical = "ransom|exfil|domain admin|critical|root compromise"
    high = "malware|lateral|suspicious|powershell|privilege|high"
    return f"case when {words(c, critical)} then 'critical' when {words(c, high)} then 'high' when {words(c, 'failed|denied|scan|warning|medium')} then 'medium' else 'low' end"


def type_sql(c: str, k: int) -> str:
    families = [
        ("failed password|login failed|authentication failure|invalid user", "authentication_failed", "identity"),
        ("powershell|encodedcommand|invoke-webrequest", "suspicious_powershell", "endpoint"),
        ("sudo|whoami /priv|setuid|privilege escalation", "privilege_escalation", "endpoint"),
        ("nmap|masscan|port scan|scan detected", "port_scan", "network"),
        ("c2|beacon|malware|trojan|ransomware", "malware_detected", "endpoint"),
        ("rlogin|psexec|smb session|winrm|lateral", "lateral_movement", "network"),
        ("email|invoice|urgent action|verify your account", "phishing_email", "email"),
    ]
    return "case " + " ".join(f"when {words(c, f[0])} then '{f[k + 1]}'" for f in families) + f" else '{('generic_security_event', 'security')[k]}' end"


IPS = lambda c: rf"regexp_extract_all({c}, '\b(?:\d{{1,3}}\.){{3}}\d{{1,3}}\b')"


def mitre_sql(c: str, k: int) -> str:
    known = {
        "authentication_failed": ("T1110", "Credential Access"), "brute_force": ("T1110", "Credential Access"), "suspicious_powershell": ("T1059.001", "Execution"), "suspicious_process": ("T1059", "Execution"),
        "privilege_escalation": ("T1068", "Privilege Escalation"), "port_scan": ("T1046", "Discovery"), "malware_detected": ("T1105", "Command and Control"), "lateral_movement": ("T1021", "Lateral Movement"),
        "phishing_email": ("T1566", "Initial Access"), "suspicious_login": ("T1078", "Defense Evasion"),
    }
    return f"case {c} " + " ".join(f"when '{t}' then '{v[k]}'" for t, v in known.items()) + " end"


PRIVATE_SQL = lambda c: rf"coalesce(regexp_matches({c}, '^10\.|^192\.168\.|^172\.(1[6-9]|2\d|3[0-1])\.|^127\.'), false)"


def geo_sql(c: str, k: int) -> str:
    """Field k of the place: 0 country, 1 city, 2 latitude, 3 longitude."""
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"cast({v} as double)"
    octet = f"case when split_part({c}, '.', 1) = '' then 0.0 else try_cast(split_part({c}, '.', 1) as double) end"
    places = [(64, "United States", "Ashburn", 39.0438, -77.4874), (128, "Germany", "Frankfurt", 50.1109, 8.6821), (192, "Singapore", "Singapore", 1.3521, 103.8198)]
    bands = " ".join(f"when {octet} < {b} then {show(where[k])}" for b, *where in places)
    return f"case when coalesce({c}, '') = '' then null when {PRIVATE_SQL(c)} then {show('internal') if k < 2 else 'cast(null as double)'} {bands} else {show(('Australia', 'Sydney', -33.8688, 151.2093)[k])} end"


J = lambda *names: "coalesce(" + ", ".join(f"json_extract_string(p, '$.{n}')" for n in names) + ", null)"
USER_BY_NAME, USER_BY_PHRASE = r"(?i)user(?:name)?[=:\s]+([\w.-]+)", r"(?i)for\s+([\w.-]+)\s+from"
SAFE_JSON = """case when payload is null then null when try_cast(payload as json) is null then cast(json_object('message', payload) as string) when json_type(try_cast(payload as json)) = 'OBJECT' then payload else concat('{"value":', payload, '}') end"""
NORM = {
    "split_sys": f"select *, coalesce(nullif(regexp_extract(payload, '{SYSLOG}', 4), ''), payload) as m from logs where source_type = 'syslog' and payload is not null",
    "split_json": f"select *, coalesce(case when object then coalesce(json_extract_string(p, '$.message'), json_extract_string(p, '$.log'), json_extract_string(p, '$.event')) end, payload, '') as m from (select *, {SAFE_JSON} as p, coalesce(json_type(try_cast(payload as json)) = 'OBJECT', false) as object from logs where source_type != 'syslog' or payload is null) q",
    "norm": f"""select event_id, ts, source_type, {type_sql('m', 0)} as event_type, {type_sql('m', 1)} as event_category, {severity_sql('m')} as severity, {IPS('m')}[1] as source_ip, {IPS('m')}[2] as destination_ip,
        cast(null as int) as destination_port, nullif(regexp_extract(payload, '{SYSLOG}', 2), '') as hostname,
        coalesce(nullif(regexp_extract(m, '{USER_BY_NAME}', 1), ''), nullif(regexp_extract(m, '{USER_BY_PHRASE}', 1), '')) as username, payload as raw_log,
        concat('{{', concat_ws(',', case when regexp_extract(payload, '{SYSLOG}', 2) != '' then concat('"syslogHost":', to_json(regexp_extract(payload, '{SYSLOG}', 2))) end, case when regexp_extract(payload, '{SYSLOG}', 3) != '' then concat('"syslogApp":', to_json(regexp_extract(payload, '{SYSLOG}', 3))) end, concat('"message":', to_json(m))), '}}') as parsed from split_sys
        union all select event_id, ts, source_type, coalesce({J('eventType')}, {type_sql('m', 0)}), coalesce({J('eventCategory', 'category')}, {type_sql('m', 1)}), coalesce({J('severity')}, {severity_sql('m')}),
        coalesce({J('sourceIp', 'src_ip')}, {IPS("concat_ws(' ', m, p)")}[1]), coalesce({J('destinationIp', 'dst_ip')}, {IPS("concat_ws(' ', m, p)")}[2]), try_cast({J('destinationPort', 'dst_port')} as int), {J('hostname', 'host')}, {J('username', 'user')}, payload, p from split_json""",
    "by_host": "select lower(hostname) as k, min(id) as id from assets group by 1",
    "by_ip": "select lower(ip_address) as k, min(id) as id from assets group by 1",
    "found_asset": "select n.*, coalesce(h.id, i.id) as asset_pk from norm n left join by_host h on lower(nullif(n.hostname, '')) = h.k left join by_ip i on lower(coalesce(nullif(n.source_ip, ''), nullif(n.destination_ip, ''))) = i.k",
    "with_asset": "select f.*, a.criticality, a.hostname as asset_host from found_asset f left join assets a on f.asset_pk = a.id",
    "candidate": f"select distinct event_id, unnest(list_concat([source_ip, destination_ip, username, hostname], {IPS('raw_log')})) as value from norm",
    "hits": "select c.event_id, count(*) as n, string_agg(concat(i.id, ':', i.ioc_value), '|' order by i.id) as shown from candidate c join iocs i on c.value = i.ioc_value group by c.event_id",
    "counted": "".join(
        [
            "select a.*, coalesce(h.n, 0) as n_ioc, ",
            "case when coalesce(source_ip, '') = '' then 1 else count(*) over (partition by source_ip order by ts range between interval 720 minutes preceding and current row) - (count(*) over (partition by source_ip, ts) - row_number() over (partition by source_ip, ts order by a.event_id)) end as by_ip, ",
            "case when coalesce(username, '') = '' then 1 else count(*) over (partition by username order by ts range between interval 720 minutes preceding and current row) - (count(*) over (partition by username, ts) - row_number() over (partition by username, ts order by a.event_id)) end as by_user ",
            "from with_asset a left join hits h on a.event_id = h.event_id",
        ]
    ).replace("as by_ip", "as n_ip").replace("as by_user", "as n_user"),
}
WEIGHT_SQL = "case severity when 'critical' then 35 when 'high' then 25 when 'medium' then 15 else 5 end"
ASSET_SQL = "case criticality when 'critical' then 12 when 'high' then 8 else 0 end"

#: One rule for each kind of predicate.
RULES = [
    rules.Rule(1, "R1", "Failed logins", "medium", {"eventTypes": ["authentication_failed"], "categories": ["identity"]}, None, None, None, None, 30),
    rules.Rule(2, "R2", "All words", "low", {"allKeywords": ["Failed", "SSH2"]}, "T9999", None, None, None, 40),
    rules.Rule(3, "R3", "Any words", None, {"anyKeywords": ["nmap", "encodedcommand"]}, None, None, None, None, None),
    rules.Rule(4, "R4", "User by regex", "high", {"rawRegex": r"user=u\d*7\b"}, None, None, None, None, 45),
    rules.Rule(5, "R5", "Known indicator", "critical", {"matchIoc": True}, "T1071", "Command and Control", None, None, 20),
    rules.Rule(6, "R6", "Weighty asset", "medium", {"assetCriticalities": ["critical", "high"], "eventTypes": ["port_scan"]}, None, None, None, None, 50),
    rules.Rule(7, "R7", "Busy source", "high", {"threshold": {"field": "sourceIp", "count": 3, "windowMinutes": 720}}, None, None, None, None, 55),
    rules.Rule(8, "R8", "Busy user", "medium", {"matchIoc": True, "threshold": {"field": "username", "count": 2, "windowMinutes": 720}}, None, None, None, None, 60),
    rules.Rule(9, "R9", "Parsed words", "low", {"anyKeywords": ['"syslogHost":"HOST-7', '{"value":']}, None, None, None, None, 10),
]


def matches_sql() -> str:
    """(event columns, rule, confidence, reasons, technique, tactic) of every match of RULES."""
    low = "lower(concat(raw_log, ' ', coalesce(parsed, '{}'), ' ', event_type, ' ', event_category))"
    tests = {
        1: ("event_type = 'authentication_failed' and event_category = 'identity'", []),
        2: (f"contains({low}, 'failed') and contains({low}, 'ssh2')", []),
        3: (f"contains({low}, 'nmap') or contains({low}, 'encodedcommand')", []),
        4: (r"regexp_matches(raw_log, '(?i)user=u\d*7\b')", [r"'Matched regex user=u\d*7\b'"]),
        5: ("n_ioc > 0", ["'Matched IOC enrichment hit'"]),
        6: ("criticality in ('critical', 'high') and event_type = 'port_scan'", ["concat('Asset criticality ', criticality)"]),
        7: ("n_ip >= 3", ["concat('Threshold met on sourceIp: ', n_ip, '/3 in 720m')"]),
        8: ("n_ioc > 0 and n_user >= 2", ["'Matched IOC enrichment hit'", "concat('Threshold met on username: ', n_user, '/2 in 720m')"]),
        9: (f"contains({low}, '\"sysloghost\":\"host-7') or contains({low}, '{{\"value\":')", []),
    }
    parts = []
    for r in RULES:
        test, reasons = tests[r.id]
        weight = 50 if r.confidence_weight is None else r.confidence_weight
        shown = f"concat_ws('; ', {', '.join(reasons)})" if reasons else f"'Matched Sigma-like logic for {r.rule_name}'"
        text = lambda v: "cast(null as string)" if v is None else f"'{v}'"
        tactic = f"coalesce({mitre_sql('event_type', 1)}, {text(r.attack_tactic or ('Detection' if r.attack_technique else None))})"
        parts.append(
            f"select *, cast({r.id} as bigint) as rule_pk, '{r.rule_id}' as rule_id, '{r.rule_name}' as rule_name, {text(r.severity)} as rule_severity, "
            f"cast(least(99, {weight} + {WEIGHT_SQL} + case when n_ioc > 0 then 15 else 0 end + {ASSET_SQL} + {3 * len(reasons)}) as int) as confidence, {shown} as reasons, "
            f"coalesce({mitre_sql('event_type', 0)}, {text(r.attack_technique)}) as mitre_technique, {tactic} as mitre_tactic from counted where {test}"
        )
    return " union all ".join(parts)


NORM["matched"] = matches_sql()
OPENS = "(confidence >= 85 or coalesce(rule_severity = 'critical', false))"
INCIDENT_SQL = f"case when {OPENS} then sha256(concat(event_id, ':', rule_id, ':incident')) end"


def normed(d: Data) -> DataFrame:
    return normalize.normalize_events(normalize.spread(d.logs))


def matched(d: Data) -> DataFrame:
    return detect.detect(normed(d), d.assets, d.iocs, d.cves, RULES)


# ---- sources ------------------------------------------------------------------------------------------------------


@query("select cast(s_suppkey as bigint) as id, concat('asset-', s_suppkey) as asset_id, 'server' as asset_type, 'production' as environment, case s_suppkey % 5 when 0 then 'critical' when 1 then 'medium' else 'low' end as criticality from supplier where s_suppkey % 5 != 2")
def append_defaults(d: Data) -> DataFrame:
    from ..sources.tables import conformed

    rows = d.supplier.selectExpr("s_suppkey as id", "concat('asset-', s_suppkey) as asset_id", "case s_suppkey % 5 when 0 then 'critical' when 1 then null when 2 then 'odd' else 'low' end as criticality")
    return conformed(rows, "assets").select("id", "asset_id", "asset_type", "environment", "criticality")


@query("select cast(coalesce(s.s_suppkey, u.k) as bigint) as k, case when u.k is not null then u.name else s.s_name end as name, s.s_nationkey as s_nationkey from supplier s full join (select k, arg_max(name, o) as name from (select l_suppkey * 2 as k, case when max(l_orderkey) % 3 = 0 then null else cast(max(l_orderkey) as string) end as name, l_returnflag as o from lineitem group by l_suppkey, l_returnflag) q group by k) u on s.s_suppkey = u.k".replace("arg_max(name, o)", "arg_max_null(name, o)"))
def upsert_by_key(d: Data) -> DataFrame:
    from ..sources.tables import upsert_by_key as upsert

    new = d.lineitem.groupBy((F.col("l_suppkey") * 2).alias("k"), F.col("l_returnflag").alias("o")).agg(F.expr("case when max(l_orderkey) % 3 = 0 then null else cast(max(l_orderkey) as string) end").alias("name"))
    return upsert(d.supplier.selectExpr("s_suppkey as k", "s_name as name", "s_nationkey"), new, "k", ["name"], "o")


@query()
def merge_by_key(d: Data) -> DataFrame:
    """The same as upsert_by_key, by a stored table that takes the updates of one order after the other."""
    path, ddl = scratch_path(d.spark, "merged"), "k long, name string, s_nationkey int"
    merge.merge_by_key(d.supplier.selectExpr("cast(s_suppkey as bigint) as k", "s_name as name", "s_nationkey", "'' as o"), path, ddl, "k", ["name", "s_nationkey"], "o", buckets=16)
    new = d.lineitem.groupBy((F.col("l_suppkey") * 2).cast("long").alias("k"), F.col("l_returnflag").alias("o")).agg(F.expr("case when max(l_orderkey) % 3 = 0 then null else cast(max(l_orderkey) as string) end").alias("name"))
    for flag in ("A", "N", "R"):
        merge.merge_by_key(new.where(F.col("o") == flag), path, ddl, "k", ["name"], "o")
    return merge.read_merged(d.spark, path, ddl)


SQL["merge_by_key"] = SQL["upsert_by_key"]


def held(d: Data, df: DataFrame, label: str) -> str:
    """`df` as a Parquet table in a folder of its own under the shared one; its path."""
    path = scratch_path(d.spark, label)
    df.write.parquet(path)
    return path


@query("select id, asset_id, hostname, criticality, len(services) as services, cast(null as string) as operating_system from assets")
def read_table(d: Data) -> DataFrame:
    return tables.read_table(d.spark, "assets", held(d, d.assets, "assets")).select("id", "asset_id", "hostname", "criticality", F.size("services").cast("long").alias("services"), "operating_system")


@query("select id, asset_id, hostname, criticality, len(services) as services, cast(null as string) as operating_system from assets where criticality != 'low'")
def read_table_jdbc(d: Data) -> DataFrame:
    """The same table from a database (the one that Spark brings, in memory), in splits, with a condition that the database answers."""
    where = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = d.assets.select(F.col("id").alias("ID"), F.col("asset_id").alias("ASSETID"), F.col("hostname").alias("HOSTNAME"), F.col("criticality").alias("CRITICALITY"), F.to_json("services").alias("SERVICES"))
    rows.write.format("jdbc").options(**where, dbtable="ASSETS", createTableColumnTypes="CRITICALITY varchar(20)").mode("append").save()
    found = tables.read_table(d.spark, "assets", where="CRITICALITY != 'low'", dbtable="ASSETS", partitionColumn="ID", numPartitions=4, **where)
    return found.select("id", "asset_id", "hostname", "criticality", F.size("services").cast("long").alias("services"), "operating_system")


@query("select payload, count(*) as lines, count(*) as ids, count(*) as again, 'raw' as source_type, cast(7 as bigint) as asset_id from (select concat('line ', user_id, ' ', event_type) as payload from events) q group by payload")
def read_raw_logs(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "lines")
    d.events.select(F.concat_ws(" ", F.lit("line"), "user_id", "event_type")).write.text(path)
    lines, again = [tables.read_raw_logs(d.spark, path, "raw", asset_id=7, split_bytes=1 << 14) for _ in range(2)]
    met = lines.join(again.select(F.col("event_id").alias("__id")), F.col("event_id") == F.col("__id"), "left")
    return met.groupBy("payload", "source_type", "asset_id").agg(F.count("*").alias("lines"), F.count_distinct("event_id").alias("ids"), F.count("__id").alias("again"))


@query("select cast(s_suppkey as bigint) as id, case s_suppkey % 5 when 0 then 'critical' when 1 then 'medium' when 2 then 'odd' else 'low' end as criticality, case when s_suppkey % 5 = 2 then 'criticality=odd' end as reject_reason from supplier")
def append_rows(d: Data) -> DataFrame:
    rows = d.supplier.selectExpr("s_suppkey as id", "case s_suppkey % 5 when 0 then 'critical' when 1 then null when 2 then 'odd' else 'low' end as criticality")
    path = scratch_path(d.spark, "assets")
    tables.append_rows(rows.where("id % 2 = 0"), "assets", path)
    tables.append_rows(rows.where("id % 2 = 1"), "assets", path)
    taken = tables.read_table(d.spark, "assets", path).withColumn("reject_reason", F.lit(None).cast("string"))
    return taken.unionByName(tables.read_rejected(d.spark, "assets", path)).select("id", "criticality", "reject_reason")


# ---- normalisation ------------------------------------------------------------------------------------------------


@query(f"select event_id, {SAFE_JSON} as parsed from logs")
def safe_json(d: Data) -> DataFrame:
    return d.logs.select("event_id", normalize.safe_json(F.col("payload")).alias("parsed"))


@query(f"select event_id, array_to_string({IPS('payload')}, '|') as ips from logs")
def extract_ips(d: Data) -> DataFrame:
    return d.logs.select("event_id", bar(T.extract_ips(F.col("payload"))).alias("ips"))


@query("select event_id, cast(case event_id % 4 when 0 then event_id % 65536 when 1 then event_id % 100 else null end as int) as port from events")
def extract_port(d: Data) -> DataFrame:
    raw = F.expr("case event_id % 4 when 0 then cast(event_id % 65536 as string) when 1 then concat(' ', event_id % 100, ' ') when 2 then concat(event_id, 'd') else '' end")
    return d.events.select("event_id", T.extract_port(raw).alias("port"))


@query(f"select event_id, {severity_sql('payload')} as severity from logs")
def infer_severity(d: Data) -> DataFrame:
    return d.logs.select("event_id", T.infer_severity(F.col("payload")).alias("severity"))


@query(f"select event_id, {type_sql('payload', 0)} as event_type, {type_sql('payload', 1)} as event_category from logs")
def infer_type(d: Data) -> DataFrame:
    return d.logs.select("event_id", T.infer_type(F.col("payload")).alias("t")).select("event_id", "t.*")


EVENT = ["event_id", "ts", "source_type", "event_type", "event_category", "severity", "source_ip", "destination_ip", "hostname", "username", "raw_log"]


@query(f"select {', '.join(EVENT)} from norm where source_type = 'syslog'", NORM)
def normalize_syslog(d: Data) -> DataFrame:
    return normalize.normalize_syslog(d.logs.where("source_type = 'syslog'")).select(*EVENT)


@query(f"select {', '.join(EVENT)}, destination_port from norm where source_type != 'syslog'", NORM)
def normalize_json(d: Data) -> DataFrame:
    return normalize.normalize_json(d.logs.where("source_type != 'syslog'")).select(*EVENT, "destination_port")


@query(f"select {', '.join(EVENT)} from norm", NORM)
def normalize_events(d: Data) -> DataFrame:
    return normed(d).select(*EVENT)


@query("select distinct event_id, source_type from logs")
def dedupe_event_id(d: Data) -> DataFrame:
    return normalize.dedupe_event_id(d.logs.unionByName(d.logs.where("source_type = 'raw'"))).select("event_id", "source_type")


# ---- feeds --------------------------------------------------------------------------------------------------------

IAM = "select iam_event_id as event_id, ts, 'iam' as source_type, case when anomaly_score >= 75 then 'suspicious_login' else 'authentication_failed' end as event_type, 'identity' as event_category, case when anomaly_score >= 75 then 'high' else 'medium' end as severity, source_ip, cast(null as string) as hostname, actor as username, concat(provider, ' ', action, ' by ', actor) as message from iam"
ENDPOINT = "select telemetry_id as event_id, ts, 'endpoint' as source_type, case when contains(lower(process_name), 'powershell') then 'suspicious_powershell' else 'suspicious_process' end as event_type, 'endpoint' as event_category, severity, destination_ip as source_ip, hostname, username, concat(coalesce(nullif(process_name, ''), 'process'), ' observed on ', hostname) as message from endpoint"
CLOUD = "select finding_id as event_id, ts, 'cloud' as source_type, 'cloud_misconfiguration' as event_type, 'cloud' as event_category, severity, cast(null as string) as source_ip, resource_id as hostname, cast(null as string) as username, concat(provider, ' ', coalesce(nullif(service, ''), 'resource'), ' finding: ', finding_type) as message from cloud"
FEED = ["event_id", "ts", "source_type", "event_type", "event_category", "severity", "source_ip", "hostname", "username"]


def with_message(events: DataFrame) -> DataFrame:
    return events.select(*FEED, F.get_json_object("parsed_data", "$.message").alias("message"))


@query(IAM)
def iam_to_events(d: Data) -> DataFrame:
    return with_message(domains.iam_to_events(d.iam))


@query(ENDPOINT)
def endpoint_to_events(d: Data) -> DataFrame:
    return with_message(domains.endpoint_to_events(d.endpoint))


@query(CLOUD)
def cloud_to_events(d: Data) -> DataFrame:
    return with_message(domains.cloud_to_events(d.cloud))


@query("select detection_id as event_id, ts, 'manual' as source_type, 'new' as status, confidence from entered")
def manual_events(d: Data) -> DataFrame:
    return domains.manual_events(d.entered.selectExpr("detection_id as event_id", "ts", "confidence")).select("event_id", "ts", "source_type", "status", "confidence")


@query(f"select {', '.join(FEED)} from norm union all select {', '.join(FEED)} from f_iam union all select {', '.join(FEED)} from f_endpoint union all select {', '.join(FEED)} from f_cloud", NORM | {"f_iam": IAM, "f_endpoint": ENDPOINT, "f_cloud": CLOUD})
def unified_events(d: Data) -> DataFrame:
    return domains.unified_events(d.logs, domains.iam_to_events(d.iam), domains.endpoint_to_events(d.endpoint), domains.cloud_to_events(d.cloud)).select(*FEED)


# ---- enrichment ---------------------------------------------------------------------------------------------------


@query("select e.event_id as event_id, a.asset_id as found, a.criticality as criticality from events e left join assets a on e.user_id = a.id")
def asset_by_id(d: Data) -> DataFrame:
    return enrich.asset_by_id(d.events.selectExpr("event_id", "user_id as asset_id"), d.assets).select("event_id", F.col("asset.asset_id").alias("found"), "asset.criticality")


@query("select event_id, asset_pk, criticality, asset_host from with_asset", NORM)
def asset_lookup(d: Data) -> DataFrame:
    return enrich.asset_lookup(normed(d), d.assets).select("event_id", F.col("asset.id").alias("asset_pk"), "asset.criticality", F.col("asset.hostname").alias("asset_host"))


@query("select n.event_id as event_id, cast(coalesce(h.n, 0) as bigint) as hits, coalesce(h.shown, '') as shown from norm n left join hits h on n.event_id = h.event_id", NORM)
def ioc_hits(d: Data) -> DataFrame:
    shown = bar(F.transform("ioc_hits", lambda h: F.concat(h["id"].cast("string"), F.lit(":"), h["value"])))
    return enrich.ioc_hits(normed(d), d.iocs).select("event_id", F.size("ioc_hits").cast("long").alias("hits"), shown.alias("shown"))


@query("select event_id from norm where event_id in (select event_id from hits)", NORM)
def ioc_semi(d: Data) -> DataFrame:
    return enrich.ioc_semi(normed(d), d.iocs).select("event_id")


@query("select event_id from norm where event_id not in (select event_id from hits)", NORM)
def ioc_anti(d: Data) -> DataFrame:
    return enrich.ioc_semi(normed(d), d.iocs, has=False).select("event_id")


@query(f"select event_id, {PRIVATE_SQL('source_ip')} as private from norm", NORM)
def is_private_ip(d: Data) -> DataFrame:
    return normed(d).select("event_id", net.is_private_ip(F.col("source_ip")).alias("private"))


@query(f"select event_id, {geo_sql('source_ip', 0)} as country, {geo_sql('source_ip', 1)} as city, {geo_sql('source_ip', 2)} as latitude, {geo_sql('source_ip', 3)} as longitude from norm", NORM)
def geo_lookup(d: Data) -> DataFrame:
    return normed(d).select("event_id", net.geo_lookup(F.col("source_ip")).alias("g")).select("event_id", "g.country", "g.city", "g.latitude", "g.longitude")


CANDIDATES = {
    "prod": "select cve_id, severity, published_date, unnest(affected_products) as product from cves",
    "asset_text": "select id, lower(cast(to_json(services) as string)) as haystack from assets",
    "asset_cve": "select id, cve_id, cast(row_number() over (partition by id order by published_date desc nulls last, cve_id) as int) as rank from (select distinct a.id, p.cve_id, p.published_date from asset_text a join prod p on contains(a.haystack, p.product)) q",
}


@query("select id, cve_id, rank from asset_cve where rank <= 5", CANDIDATES)
def cve_candidates(d: Data) -> DataFrame:
    return enrich.cve_candidates(d.assets, d.cves).select("id", "cve_id", "rank")


@query(f"select event_id, {mitre_sql('event_type', 0)} as technique, {mitre_sql('event_type', 1)} as tactic from norm", NORM)
def mitre_lookup(d: Data) -> DataFrame:
    return normed(d).select("event_id", scoring.mitre_lookup(F.col("event_type")).alias("m")).select("event_id", "m.technique", "m.tactic")


@query(
    f"select w.event_id as event_id, {geo_sql('source_ip', 0)} as source_country, {geo_sql('destination_ip', 1)} as destination_city, w.asset_pk as asset_pk, cast(coalesce(h.n, 0) as bigint) as hits, coalesce(c.cves, '') as cves, {mitre_sql('event_type', 0)} as technique from with_asset w left join hits h on w.event_id = h.event_id left join (select id, string_agg(cve_id, '|' order by rank) as cves from asset_cve where rank <= 5 group by id) c on w.asset_pk = c.id",
    NORM | CANDIDATES,
)
def enrich_events(d: Data) -> DataFrame:
    e = enrich.enrich_events(normed(d), d.assets, d.iocs, d.cves)
    return e.select("event_id", F.col("enrichment.geo.source.country").alias("source_country"), F.col("enrichment.geo.destination.city").alias("destination_city"), F.col("enrichment.asset_context.id").alias("asset_pk"), F.size("enrichment.ioc_hits").cast("long").alias("hits"), bar("enrichment.cve_candidates.cve_id").alias("cves"), F.col("enrichment.mitre.technique").alias("technique"))


# ---- detection ----------------------------------------------------------------------------------------------------

RULE_ROWS = """select cast(p_partkey as bigint) as id, concat('R', p_partkey) as rule_id, p_name as rule_name, p_partkey % 3 != 0 as enabled, case p_partkey % 4 when 0 then '{"eventTypes":["x"]}' when 1 then '{}' when 2 then null else 'odd' end as detection_logic,
    case p_partkey % 5 when 0 then ' , ' when 1 then null when 2 then '' else ' nmap, Failed ,,ssh' end as pattern, p_size as updated_at from part"""
LOGIC_SQL = """case when p_partkey % 4 = 0 then '{"eventTypes":["x"]}' when p_partkey % 4 = 1 then '{}' when p_partkey % 5 in (1, 2) then '{}' when p_partkey % 5 = 0 then '{"anyKeywords":[]}' else '{"anyKeywords":["nmap","Failed","ssh"]}' end"""


def rule_rows(d: Data) -> DataFrame:
    return d.part.selectExpr("p_partkey as id", "concat('R', p_partkey) as rule_id", "p_partkey % 3 != 0 as enabled", "p_size as updated_at", """case p_partkey % 4 when 0 then '{"eventTypes":["x"]}' when 1 then '{}' when 2 then null else 'odd' end as detection_logic""", "case p_partkey % 5 when 0 then ' , ' when 1 then null when 2 then '' else ' nmap, Failed ,,ssh' end as pattern")


@query("select p_partkey as id, p_size as updated_at from part where p_partkey % 3 != 0 order by p_size desc, p_partkey desc limit 100")
def active_rules(d: Data) -> DataFrame:
    return rules.active_rules(rule_rows(d)).select("id", "updated_at").limit(100)


@query(f"select p_partkey as id, {LOGIC_SQL} as logic from part")
def normalize_rule_logic(d: Data) -> DataFrame:
    return rule_rows(d).select("id", rules.normalize_rule_logic(F.col("detection_logic"), F.col("pattern")).alias("logic"))


@query("select event_id from norm where event_type in ('authentication_failed', 'port_scan') and username in ('u1', 'u7', 'u12')", NORM)
def rule_membership(d: Data) -> DataFrame:
    return normed(d).where(rules.rule_membership({"eventTypes": ["authentication_failed", "port_scan"], "usernames": ["u1", "u7", "u12"], "protocols": []})).select("event_id")


@query("""select event_id from (select event_id, lower(concat(coalesce(raw_log, ''), ' ', coalesce(parsed, '{}'), ' ', event_type, ' ', event_category)) as low from norm) q where contains(low, 'scan') and (contains(low, 'sysloghost":"host-1') or contains(low, 'nmap'))""", NORM)
def rule_keywords(d: Data) -> DataFrame:
    return normed(d).where(rules.rule_keywords({"allKeywords": ["SCAN"], "anyKeywords": ['syslogHost":"host-1', "Nmap"]}, rules.searchable())).select("event_id")


#: So many rules that they are looked up by their keys.
MANY = [
    rules.Rule(k, f"K{k}", f"Rule {k}", None, [
        {"anyKeywords": [f"U{k} from", f"user=u{k} ", f'"user":"u{k}"']}, {"usernames": [f"u{k}"], "eventTypes": ["authentication_failed", "port_scan"]}, {"allKeywords": [f"host-{k % 100}", "Failed"]},
        {"rawRegex": rf"\bu{k}\b.*ssh2", "categories": ["identity"]}, {"threshold": {"field": "username", "count": 2 + k % 7, "windowMinutes": 720}, "anyKeywords": [f"u{k % 40} "]}, {"matchIoc": True, "assetCriticalities": ["high", "low"], "destinationPorts": [k, k + 1]},
    ][k % 6]) for k in range(300)
]
MANY_SQL = r"""select event_id, concat('K', k) as rule_id from (select *, lower(concat(coalesce(raw_log, ''), ' ', coalesce(parsed, '{}'), ' ', event_type, ' ', event_category)) as low from counted) e cross join (select unnest(range(300)) as k) r where case k % 6
    when 0 then contains(low, concat('u', k, ' from')) or contains(low, concat('user=u', k, ' ')) or contains(low, concat('"user":"u', k, '"')) when 1 then username = concat('u', k) and event_type in ('authentication_failed', 'port_scan')
    when 2 then contains(low, concat('host-', k % 100)) and contains(low, 'failed') when 3 then event_category = 'identity' and regexp_matches(coalesce(raw_log, ''), concat('(?i)\bu', k, '\b.*ssh2'))
    when 4 then contains(low, concat('u', k % 40, ' ')) and n_user >= 2 + k % 7 else n_ioc > 0 and criticality in ('high', 'low') and destination_port in (k, k + 1) end"""


@query(MANY_SQL, NORM)
def rule_index(d: Data) -> DataFrame:
    return detect.detect(normed(d), d.assets, d.iocs, d.cves, MANY).select("event_id", "match.rule_id")


@query(r"select event_id from norm where regexp_matches(raw_log, '(?i)PORT \d+5\b')", NORM)
def rule_regex(d: Data) -> DataFrame:
    return normed(d).where(rules.rule_regex({"rawRegex": r"PORT \d+5\b"})).select("event_id")


@query("select event_id from counted where n_ioc > 0", NORM)
def rule_ioc_gate(d: Data) -> DataFrame:
    return enrich.ioc_hits(normed(d), d.iocs).where(rules.rule_ioc_gate({"matchIoc": True})).select("event_id")


@query("select event_id from with_asset where criticality in ('critical', 'low')", NORM)
def rule_asset_gate(d: Data) -> DataFrame:
    return enrich.asset_lookup(normed(d), d.assets).where(rules.rule_asset_gate({"assetCriticalities": ["critical", "low"]})).select("event_id")


@query("select event_id, cast(n_ip as bigint) as n_ip, cast(n_user as bigint) as n_user from counted", NORM)
def threshold_window(d: Data) -> DataFrame:
    wanted = {name: (key, rules.micros(), 720 * 60_000_000) for name, key in (("n_ip", "source_ip"), ("n_user", "username"))}
    return rules.sliding_counts(normed(d).select("event_id", "ts", "source_ip", "username"), wanted).select("event_id", "n_ip", "n_user")


@query("select event_id, rule_id, confidence from matched", NORM)
def rule_confidence(d: Data) -> DataFrame:
    return matched(d).select("event_id", "match.rule_id", "match.confidence")


@query("select event_id, rule_id, reasons from matched", NORM)
def match_reasons(d: Data) -> DataFrame:
    return matched(d).select("event_id", "match.rule_id", F.array_join("match.reasons", "; ").alias("reasons"))


@query("select event_id, rule_id, mitre_technique, mitre_tactic from matched", NORM)
def match_mitre(d: Data) -> DataFrame:
    return matched(d).select("event_id", "match.rule_id", "match.mitre_technique", "match.mitre_tactic")


@query("select rule_id, count(*) as matches, cast(sum(confidence) as bigint) as confidence from matched group by rule_id", NORM)
def evaluate_rules(d: Data) -> DataFrame:
    return matched(d).groupBy("match.rule_id").agg(F.count("*").alias("matches"), F.sum("match.confidence").alias("confidence"))


@query(f"select sha256(concat(event_id, ':', rule_id, ':detection')) as detection_id, rule_pk as rule_id, event_id, source_ip, destination_ip, {INCIDENT_SQL} as incident_id, confidence, reasons, mitre_technique, mitre_tactic, ts from matched", NORM)
def detections(d: Data) -> DataFrame:
    return detect.detections(matched(d)).withColumn("reasons", F.array_join("match_reasons", "; ")).drop("match_reasons")


ALERTS_SQL = f"select sha256(concat(event_id, ':', rule_id, ':alert')) as alert_id, concat(rule_name, ' matched on ', coalesce(nullif(hostname, ''), nullif(source_ip, ''), event_type)) as title, reasons as description, coalesce(rule_severity, severity, 'medium') as severity, rule_id, case when {OPENS} then 'triaged' else 'new' end as status, {INCIDENT_SQL} as incident_id, ts from matched"


@query(ALERTS_SQL, NORM)
def alerts(d: Data) -> DataFrame:
    return detect.alerts(matched(d)).select("alert_id", "title", "description", "severity", "rule_id", "status", "incident_id", "ts")


@query(f"select {INCIDENT_SQL} as incident_id, concat('Detection: ', rule_name) as title, concat('Auto-created from ingestion pipeline for ', event_type) as description, coalesce(rule_severity, severity, 'medium') as severity, 'open' as status, event_category as classification, coalesce(asset_host, '') as affected, ts as detected_at from matched where {OPENS}", NORM)
def auto_incidents(d: Data) -> DataFrame:
    return detect.auto_incidents(matched(d)).withColumn("affected", F.coalesce(bar("affected_assets"), F.lit(""))).drop("affected_assets")


@query(f"select {INCIDENT_SQL} as incident_id, 'Auto-created from detection pipeline' as action, rule_name as rule, ts from matched where {OPENS}", NORM)
def incident_audit(d: Data) -> DataFrame:
    return detect.incident_audit(matched(d)).select("incident_id", "action", F.get_json_object("details", "$.rule").alias("rule"), "ts")


@query("select sha256(concat(detection_id, ':incident')) as incident_id, concat('IDS Detection - Rule ', rule_id) as title, 'high' as severity, 'open' as status, ts as detected_at from entered where confidence >= 75")
def manual_detection_promote(d: Data) -> DataFrame:
    return detect.manual_detection_promote(d.entered)


@query("select sha256(concat('events.ingest:', event_id)) as audit_id, cast(user_id as bigint) as actor_user_id, 'events.ingest' as action, 'event' as entity_type, cast(event_id as string) as entity_id, 'success' as outcome, props as details from events")
def platform_audit(d: Data) -> DataFrame:
    return detect.platform_audit(d.events, F.col("user_id"), "events.ingest", "event", F.col("event_id"), F.col("props"))


@query("select n.event_id as event_id, coalesce(m.n, 0) as detections, coalesce(m.n, 0) as alerts from norm n left join (select event_id, count(*) as n from matched group by 1) m on n.event_id = m.event_id", NORM)
def ingest_summary(d: Data) -> DataFrame:
    return detect.ingest_summary(d.logs, matched(d))


# ---- vulnerabilities ----------------------------------------------------------------------------------------------

VULN = {
    "prod": CANDIDATES["prod"],
    "hay": "select *, lower(concat(service, ' ', coalesce(product, ''), ' ', coalesce(version, ''), ' ', coalesce(banner, ''))) as haystack from services",
    "best": "select haystack, cve_id, cast(row_number() over (partition by haystack order by published_date desc nulls last, cve_id) as int) as rank from (select distinct h.haystack, p.cve_id, p.published_date from (select distinct haystack from hay) h join prod p on contains(h.haystack, p.product)) q",
    "hit": "select h.*, b.cve_id, c.cvss_score, c.description from hay h join best b on h.haystack = b.haystack join cves c on b.cve_id = c.cve_id where b.rank <= 3",
    "finding": "select sha256(concat(scan_id, ':', position, ':', cve_id)) as vulnerability_id, scan_id, cve_id, concat(product, ' exposure mapped to ', cve_id) as title, description, case when coalesce(cvss_score, 5) >= 9 then 'critical' when coalesce(cvss_score, 5) >= 7 then 'high' when coalesce(cvss_score, 5) >= 4 then 'medium' else 'low' end as severity, product as affected_service, port as affected_port, concat('Validate version ', version, '; patch or mitigate according to ', cve_id, '.') as remediation_steps, 'open' as status from hit",
}


def stated(d: Data) -> DataFrame:
    return d.services.withColumn("haystack", vuln.service_haystack(*map(F.col, ("service", "product", "version", "banner"))))


def found_vulns(d: Data) -> DataFrame:
    return vuln.findings(vuln.cve_service_match(d.services, d.cves))


@query("select scan_id, position, haystack from hay", VULN)
def service_haystack(d: Data) -> DataFrame:
    return stated(d).select("scan_id", "position", "haystack")


@query("select scan_id, position, cve_id from hit", VULN)
def cve_service_match(d: Data) -> DataFrame:
    return vuln.cve_service_match(d.services, d.cves).select("scan_id", "position", "cve_id")


@query("select cve_id, case when coalesce(cvss_score, 5) >= 9 then 'critical' when coalesce(cvss_score, 5) >= 7 then 'high' when coalesce(cvss_score, 5) >= 4 then 'medium' else 'low' end as severity from cves")
def cvss_severity(d: Data) -> DataFrame:
    return d.cves.select("cve_id", scoring.cvss_severity(F.col("cvss_score")).alias("severity"))


@query("select * from finding", VULN)
def findings(d: Data) -> DataFrame:
    return found_vulns(d)


@query("select s.scan_id as scan_id, cast(count(f.severity) as bigint) as vulnerabilities_found, cast(count(*) filter (f.severity = 'critical') as bigint) as critical_count, cast(count(*) filter (f.severity = 'high') as bigint) as high_count, cast(count(*) filter (f.severity = 'medium') as bigint) as medium_count, cast(count(*) filter (f.severity = 'low') as bigint) as low_count, cast(coalesce(sum(case f.severity when 'critical' then 9 when 'high' then 6 when 'medium' then 3 when 'low' then 1 end), 0) as decimal(12,2)) as risk_score, try_cast(coalesce(sum(case f.severity when 'critical' then 9 when 'high' then 6 when 'medium' then 3 when 'low' then 1 end), 0) as decimal(5,2)) as risk_small, 'completed' as status from scans s left join finding f on s.scan_id = f.scan_id group by s.scan_id", VULN)
def scan_rollup(d: Data) -> DataFrame:
    return vuln.scan_rollup(d.scans, found_vulns(d))


@query("select s.scan_id as scan_id, s.created_at as end_time, coalesce(f.shown, '') as found from scans s left join (select scan_id, string_agg(concat(cve_id, ' ', severity, ' ', title), '|' order by vulnerability_id) as shown from finding group by 1) f on s.scan_id = f.scan_id", VULN)
def scan_results(d: Data) -> DataFrame:
    made = vuln.scan_results(d.scans, vuln.service_matches(d.services, d.cves), F.lit(None)).join(d.scans.select("scan_id", "created_at"), "scan_id")
    held = F.from_json("results", "matchedFindings array<struct<cveId:string,severity:string,title:string>>")["matchedFindings"]
    return made.select("scan_id", F.col("created_at").alias("end_time"), bar(F.transform(held, lambda f: F.concat_ws(" ", f["cveId"], f["severity"], f["title"]))).alias("found"))


@query("select s.scan_id as scan_id, case when v.scan_id is null then 'simulation' else 'evidence-driven' end as execution_mode from scans s left join (select distinct scan_id from services) v on s.scan_id = v.scan_id")
def execution_mode(d: Data) -> DataFrame:
    grouped = d.services.groupBy("scan_id").agg(F.collect_list("port").alias("own"))
    return d.scans.join(grouped, "scan_id", "left").select("scan_id", vuln.execution_mode(F.col("own")).alias("execution_mode"))


@query("select scan_id, target_host, created_at from scans order by created_at desc, scan_id desc limit 50")
def list_scans(d: Data) -> DataFrame:
    return vuln.list_scans(d.scans)


@query("select vulnerability_id, scan_id, cve_id, severity from finding where scan_id = '7'", VULN)
def scan_vulnerabilities(d: Data) -> DataFrame:
    return vuln.scan_vulnerabilities(found_vulns(d), "7").select("vulnerability_id", "scan_id", "cve_id", "severity")


# ---- phishing -----------------------------------------------------------------------------------------------------

MAIL = {
    "signal": r"select *, regexp_extract_all(body, '(?i)https?://[^\s)]+') as urls, (regexp_matches(lower(sender), 'support-|secure-|verify-|alerts?@|billing@') or regexp_matches(lower(sender), '\.ru|\.xyz|\.top|\.click')) as odd, regexp_matches(concat(subject, ' ', body), '(?i)urgent|immediately|verify your account|password expires|invoice attached|wire transfer') as urgent, regexp_matches(body, '(?i)enable content|macro|docm|html attachment') as lure from mails",
    "scored": "select *, cast(35 + case when odd then 20 else 0 end + case when urgent then 15 else 0 end + case when len(urls) > 0 then 10 else 0 end + case when attachment_count > 0 then 10 else 0 end + case when lure then 20 else 0 end as int) as score from signal",
    "judged": "select *, case when score >= 75 then 'malicious' when score >= 55 then 'suspicious' else 'benign' end as verdict from scored",
}


@query("select mail_id, array_to_string(urls, '|') as urls from signal", MAIL)
def extract_urls(d: Data) -> DataFrame:
    return d.mails.select("mail_id", bar(phishing.extract_urls(F.col("body"))).alias("urls"))


@query("select mail_id, odd from signal", MAIL)
def suspicious_sender(d: Data) -> DataFrame:
    return d.mails.select("mail_id", phishing.suspicious_sender(F.col("sender")).alias("odd"))


@query("select mail_id as analysis_id, score, verdict, cast(least(score, 95) as int) as confidence from judged", MAIL)
def phishing_score(d: Data) -> DataFrame:
    return phishing.analyze(d.mails).select("analysis_id", "score", "verdict", "confidence")


@query("select verdict, count(*) as mails from judged group by verdict", MAIL)
def phishing_verdict(d: Data) -> DataFrame:
    return phishing.analyze(d.mails).groupBy("verdict").agg(F.count("*").alias("mails"))


@query("select mail_id as analysis_id, concat_ws('|', case when odd then 'Sender profile matches known phishing naming patterns' end, case when urgent then 'Urgency or coercion language detected' end, case when len(urls) > 0 then concat('Email contains ', len(urls), ' URL(s)') end, case when attachment_count > 0 then concat('Email has ', attachment_count, ' attachment(s)') end, case when lure then 'Attachment lure or macro execution wording present' end) as reasons from judged", MAIL)
def phishing_reasons(d: Data) -> DataFrame:
    return phishing.analyze(d.mails).select("analysis_id", bar("reasons").alias("reasons"))


@query("select mail_id as analysis_id, array_to_string(list_concat(case when odd then ['sender:' || sender] else [] end, list_transform(urls, lambda u: 'url:' || u)), '|') as indicators from judged", MAIL)
def phishing_indicators(d: Data) -> DataFrame:
    return phishing.analyze(d.mails).select("analysis_id", bar("indicators").alias("indicators"))


@query("select sha256(concat(mail_id, ':incident')) as incident_id, concat('Phishing email triage: ', subject) as title, concat('Auto-created from phishing analysis for sender ', sender) as description, case when verdict = 'malicious' then 'high' else 'medium' end as severity, 'open' as status, 'phishing' as classification from judged where verdict != 'benign'", MAIL)
def phishing_incidents(d: Data) -> DataFrame:
    return phishing.phishing_incidents(phishing.analyze(d.mails))


@query("select mail_id as event_id, 'phishing_email' as event_type, 'email' as event_category, case verdict when 'malicious' then 'high' when 'suspicious' then 'medium' else 'low' end as severity, recipient as username, concat(subject, ' from ', sender) as message from judged", MAIL)
def phishing_to_events(d: Data) -> DataFrame:
    events = domains.phishing_to_events(phishing.analyze(d.mails).withColumn("created_at", F.lit(None).cast("timestamp")))
    return events.select("event_id", "event_type", "event_category", "severity", "username", F.get_json_object("parsed_data", "$.message").alias("message"))


# ---- response and cases -------------------------------------------------------------------------------------------

STEPS = "select x.execution_id as execution_id, x.incident_id as incident_id, p.name as playbook_name, s.step as step, coalesce(s.v.name, concat('Step ', s.step)) as name, coalesce(s.v.action, 'observe') as action, case s.v.action when 'contain-host' then 'Containment action simulated and recorded' when 'disable-user' then 'Identity disablement prepared for analyst approval' when 'create-ticket' then 'Ticket payload generated' else 'Action completed in simulation mode' end as note from executions x join playbooks p on x.playbook_id = p.id join (select id, cast(unnest(range(1, len(steps) + 1)) as int) as step, unnest(steps) as v from playbooks) s on s.id = p.id"


@query(f"select execution_id, step, name, action, note from ({STEPS}) q")
def playbook_expand(d: Data) -> DataFrame:
    return cases.playbook_expand(d.executions, d.playbooks).select("execution_id", F.explode("output").alias("s")).select("execution_id", "s.step", "s.name", "s.action", "s.note")


@query("select execution_id from executions where playbook_id not in (select id from playbooks)")
def unknown_playbooks(d: Data) -> DataFrame:
    return cases.unknown_playbooks(d.executions, d.playbooks).select("execution_id")


@query("select x.incident_id as incident_id, concat('SOAR playbook executed: ', p.name) as action from executions x join playbooks p on x.playbook_id = p.id where x.incident_id is not null")
def playbook_audit(d: Data) -> DataFrame:
    return cases.playbook_audit(cases.playbook_expand(d.executions, d.playbooks)).select("incident_id", "action")


@query("select i.incident_id as incident_id, coalesce(u.status, i.status) as status, coalesce(u.ts, i.updated_at) as updated_at from incidents i left join (select incident_id, arg_max(status, ts) as status, max(ts) as ts from updates group by 1) u on i.incident_id = u.incident_id")
def apply_status_updates(d: Data) -> DataFrame:
    return cases.apply_status_updates(d.incidents, d.updates)[0].select("incident_id", "status", "updated_at")


@query("select incident_id, concat('Status changed to ', status) as action, cast(\"user\" as bigint) as performed_by, ts from updates")
def status_audit(d: Data) -> DataFrame:
    return cases.apply_status_updates(d.incidents, d.updates)[1].select("incident_id", "action", "performed_by", "ts")


@query("select a.alert_id as alert_id, coalesce(l.incident_id, a.incident_id) as incident_id from alert_rows a left join links l on a.alert_id = l.alert_id")
def link_alerts(d: Data) -> DataFrame:
    return cases.link_alerts(d.alert_rows, d.links)


@query("select incident_id, title, created_at from incidents where status = 'contained'")
def incidents_by_status(d: Data) -> DataFrame:
    return cases.incidents_by_status(d.incidents, "contained").select("incident_id", "title", "created_at")


@query("select incident_id, title, severity from incidents where incident_id = '42'")
def incident_by_id(d: Data) -> DataFrame:
    return cases.incident_by_id(d.incidents, "42").select("incident_id", "title", "severity")


@query("select incident_id, created_at from incidents order by created_at desc, incident_id desc limit 50 offset 20")
def list_incidents(d: Data) -> DataFrame:
    return cases.list_incidents(d.incidents, 50, 20).select("incident_id", "created_at")


@query("select cast(o_orderkey as string) as incident_id, cast(l_linenumber as int) as step_number, l_partkey from lineitem join orders on l_orderkey = o_orderkey where o_orderkey = 9")
def playbook_steps(d: Data) -> DataFrame:
    steps = d.lineitem.selectExpr("cast(l_orderkey as string) as incident_id", "l_linenumber as step_number", "l_partkey").join(d.incidents.select("incident_id"), "incident_id", "left_semi")
    return cases.playbook_steps(steps, "9")


@query("select incident_id, action, turn as ts, conv_id from audit where incident_id = '11'")
def audit_trail(d: Data) -> DataFrame:
    return cases.audit_trail(d.audit.withColumnRenamed("turn", "ts"), "11")


@query("select id, filename, file_size from evidence where incident_id = '5'")
def evidence_by_incident(d: Data) -> DataFrame:
    return cases.evidence_by_incident(d.evidence, "5").select("id", "filename", "file_size")


@query("select id, filename, incident_id from evidence where id = 77")
def evidence_by_id(d: Data) -> DataFrame:
    return cases.evidence_by_id(d.evidence, 77).select("id", "filename", "incident_id")


def hashed(d: Data) -> DataFrame:
    return d.evidence.withColumns(scoring.content_hashes(F.col("text")))


@query("select id as evidence_id, 'collected' as action, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from evidence")
def initial_custody(d: Data) -> DataFrame:
    return cases.initial_custody(hashed(d)).select("evidence_id", "action", "hash_snapshot.md5", "hash_snapshot.sha1", "hash_snapshot.sha256")


@query("select c.custody_event_id as custody_event_id, c.action as action, md5(e.text) as md5, sha1(e.text) as sha1, sha256(e.text) as sha256 from custody c left join evidence e on c.evidence_id = e.id")
def custody_snapshot(d: Data) -> DataFrame:
    return cases.custody_snapshot(d.custody, hashed(d)).select("custody_event_id", "action", "hash_snapshot.md5", "hash_snapshot.sha1", "hash_snapshot.sha256")


@query("select custody_event_id, action, turn as ts from custody where evidence_id = 39")
def custody_chain(d: Data) -> DataFrame:
    return cases.custody_chain(d.custody.withColumnRenamed("turn", "ts"), 39).select("custody_event_id", "action", "ts")


@query("select timeline_id, event_description, event_ts from entries where incident_id = '8'")
def timeline(d: Data) -> DataFrame:
    return cases.timeline(d.entries, "8").select("timeline_id", "event_description", "event_ts")


@query("select artifact_id, title, created_at from found where incident_id = '8'")
def artifacts(d: Data) -> DataFrame:
    return cases.artifacts(d.found, "8").select("artifact_id", "title", "created_at")


def children_sql(table: str, order: str, *shown: str) -> str:
    """Each incident's rows of a table as one text, and how many there are."""
    return f"(select incident_id, count(*) as n, string_agg(concat_ws(' ', {', '.join(shown)}), '|' order by {', '.join(f'{c} nulls first' for c in order.split())}) as v from {table} group by 1)"


OVERVIEW_SQL = {
    "evidence": children_sql("evidence", "id filename file_size", "id", "filename", "file_size"),
    "timeline": children_sql("entries", "event_ts event_description timeline_id", "event_ts", "event_description", "timeline_id"),
    "artifacts": children_sql("found", "created_at title artifact_id", "created_at - date '1970-01-01'", "title", "artifact_id"),
    "audit": children_sql("audit", "turn action conv_id", "turn", "action", "conv_id"),
}


@query("select i.*, " + ", ".join(f"coalesce({k}.v, '') as {k}, coalesce({k}.n, 0) as {k}_total" for k in OVERVIEW_SQL) + " from incidents i " + " ".join(f"left join {text} {k} on i.incident_id = {k}.incident_id" for k, text in OVERVIEW_SQL.items()))
def case_overview(d: Data) -> DataFrame:
    """Each incident with all that belongs to it, children as whole rows; the contents of evidence stay where they are."""
    whole = cases.case_overview(d.incidents, d.evidence.drop("text"), d.entries, d.found, d.audit.withColumnRenamed("turn", "ts"))
    fields = {"evidence": ("id", "filename", "file_size"), "timeline": ("event_ts", "event_description", "timeline_id"), "artifacts": ("created_at", "title", "artifact_id"), "audit": ("ts", "action", "conv_id")}
    shown = lambda child, name: F.unix_date(child[name]) if name == "created_at" else child[name]
    text = lambda kind: bar(F.transform(kind, lambda c: F.concat_ws(" ", *[shown(c, name).cast("string") for name in fields[kind]])))
    return whole.select(*d.incidents.columns, *[text(kind).alias(kind) for kind in fields], *[f"{kind}_total" for kind in fields])


# ---- intelligence, feeds, dashboard -------------------------------------------------------------------------------


@query("select id, ioc_value from iocs where lower(ioc_value) like '%.1_.%'")
def search_ioc(d: Data) -> DataFrame:
    return feeds.search_ioc(d.iocs, ".1_.").select("id", "ioc_value")


@query("select id, ioc_value, 'some' as pattern from iocs where lower(ioc_value) like '%1.1_%.2%' union all select id, ioc_value, 'short' from iocs where lower(ioc_value) like '%9_.%' union all select id, ioc_value, 'long' from iocs where lower(ioc_value) like '%10.10.1.%'")
def find_iocs(d: Data) -> DataFrame:
    """Three searches by the stored index."""
    path = scratch_path(d.spark, "grams")
    search.index_iocs(d.iocs, path, 16)
    return reduce(DataFrame.unionByName, [search.find_iocs(d.spark, path, value, 16).select("id", "ioc_value", F.lit(name).alias("pattern")) for name, value in (("some", "1.1_%.2"), ("short", "9_."), ("long", "10.10.1."))])


@query("select event_id, cast(coalesce(h.n, 0) as bigint) as hits from norm n left join hits h using (event_id)", NORM)
def ioc_hits_thinned(d: Data) -> DataFrame:
    """Hits as if the indicators were too many to be broadcast."""
    rows, known = normed(d), d.iocs.select(F.col("ioc_value").alias("value"), "id")
    found = enrich.thinned(enrich.ioc_candidates(rows), known.select("value")).join(known, "value").groupBy("event_id").agg(F.count("*").alias("hits"))
    return rows.select("event_id").join(found, "event_id", "left").select("event_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


@query("select id, ioc_value, created_at from iocs order by created_at desc, id desc limit 100 offset 10")
def list_iocs(d: Data) -> DataFrame:
    return feeds.list_iocs(d.iocs, 100, 10).select("id", "ioc_value", "created_at")


@query("select cve_id, cvss_score, published_date from cves order by published_date desc nulls last, cve_id desc limit 100")
def list_cves(d: Data) -> DataFrame:
    return feeds.list_cves(d.cves).select("cve_id", "cvss_score", "published_date")


@query("select cve_id, title from cves where cve_id = 'CVE-2024-00042'")
def cve_by_id(d: Data) -> DataFrame:
    return feeds.cve_by_id(d.cves, "cve-2024-00042").select("cve_id", "title")


@query("select id, name, known_incidents from actors order by known_incidents desc, id desc limit 20")
def top_threat_actors(d: Data) -> DataFrame:
    return feeds.top_threat_actors(d.actors)


@query("select h.id as id, h.name as name, h.service_type as service_type, coalesce(i.n, 0) as interaction_count from honeypots h left join (select honeypot_id, count(*) as n from interactions group by 1) i on h.id = i.honeypot_id")
def list_honeypots(d: Data) -> DataFrame:
    return feeds.list_honeypots(d.honeypots, d.interactions)


@query("select honeypot_id, interaction_id, ts, rank from (select *, cast(row_number() over (partition by honeypot_id order by ts desc, interaction_id desc) as int) as rank from interactions) q where rank <= 100")
def honeypot_interactions(d: Data) -> DataFrame:
    return feeds.honeypot_interactions(d.interactions).select("honeypot_id", "interaction_id", "ts", "rank")


@query("select interaction_id, ts from interactions where attacker_ip = '38.11.7.2'")
def attacker_history(d: Data) -> DataFrame:
    return feeds.attacker_history(d.interactions, "38.11.7.2").select("interaction_id", "ts")


@query("select attacker_ip, min(ts) as first_seen, max(ts) as last_seen, count(*) as interactions from interactions group by 1")
def attacker_summary(d: Data) -> DataFrame:
    return feeds.attacker_summary(d.interactions)


@query("select event_id, ts, severity from norm order by ts desc, event_id desc limit 100 offset 50", NORM)
def latest_feed(d: Data) -> DataFrame:
    return feeds.latest_feed(normed(d), "ts", "event_id", 100, 50).select("event_id", "ts", "severity")


@query("select event_id, ts, hostname from norm where severity = 'high' order by ts desc, event_id desc limit 100", NORM)
def events_by_severity(d: Data) -> DataFrame:
    return feeds.events_by_severity(normed(d), "high").select("event_id", "ts", "hostname")


@query("select event_id, ts from norm order by ts desc, event_id desc limit 300", NORM)
def recent_events(d: Data) -> DataFrame:
    return feeds.recent_events(normed(d)).select("event_id", "ts")


STATED_ALERTS = NORM | {"alert_fact": ALERTS_SQL}


@query("select severity, count(*) as count from alert_fact group by severity", STATED_ALERTS)
def alert_stats(d: Data) -> DataFrame:
    return feeds.alert_stats(detect.alerts(matched(d)))


@query("select status, count(*) as count from incidents group by status")
def incident_stats(d: Data) -> DataFrame:
    return feeds.incident_stats(d.incidents)


@query("select concat('alerts.', severity) as metric, count(*) as value, count(*) as shown from alert_fact group by severity union all select concat('incidents.', status), count(*), count(*) from incidents group by status union all select 'assets.count', count(*), least(count(*), 10) from assets union all select 'cloud.count', count(*), least(count(*), 10) from cloud union all select 'endpoint.count', count(*), least(count(*), 10) from endpoint union all select 'phishing.count', count(*), least(count(*), 10) from mails", STATED_ALERTS)
def dashboard_metrics(d: Data) -> DataFrame:
    return feeds.dashboard_metrics(detect.alerts(matched(d)), d.incidents, {"assets": d.assets, "cloud": d.cloud, "endpoint": d.endpoint, "phishing": d.mails})


@query("select count(*) filter (severity = 'critical') as critical_alerts, count(*) filter (severity = 'high') as high_alerts, (select count(*) from incidents where status = 'open') as open_incidents, (select count(*) from incidents where status = 'resolved') as resolved_incidents from alert_fact", STATED_ALERTS)
def kpi_cards(d: Data) -> DataFrame:
    return feeds.kpi_cards(detect.alerts(matched(d)), d.incidents)


@query("select event_id, ts, coalesce(nullif(hostname, ''), source_ip) as label from norm order by ts desc, event_id desc limit 50", NORM)
def event_feed(d: Data) -> DataFrame:
    return feeds.event_feed(normed(d)).select("event_id", "ts", "label")


@query("select doc_id, md5(text) as md5_hash, sha1(text) as sha1_hash, sha256(text) as sha256_hash from documents")
def content_hashes(d: Data) -> DataFrame:
    return d.documents.select("doc_id", *[c.alias(n) for n, c in scoring.content_hashes(F.col("text")).items() if n != "sha512_hash"])


# ---- whole jobs ---------------------------------------------------------------------------------------------------


@query("select event_id, rule_id, confidence, reasons from matched", NORM)
def detection_job(d: Data) -> DataFrame:
    """Raw logs through enrichment and all rules to matches."""
    return detect.ingest(d.logs, d.assets, d.iocs, d.cves, RULES).select("event_id", "match.rule_id", "match.confidence", F.array_join("match.reasons", "; ").alias("reasons"))


FACTS = ("security_events", "alerts", "ids_detections", "incidents", "incident_audit_trail")
FACTS_SQL = "select 'alerts' as fact, count(*) as n from alert_fact union all select 'ids_detections', count(*) from matched union all select 'incidents', count(*) from matched where " + OPENS + " union all select 'incident_audit_trail', count(*) from matched where " + OPENS + " union all select 'security_events', count(*) from norm"


@query(f"select fact, n, n as counted from ({FACTS_SQL}) q", NORM | {"alert_fact": ALERTS_SQL})
def write_facts(d: Data) -> DataFrame:
    """A job's facts, written twice as one run: each stays once, and its commit has counted it."""
    path = scratch_path(d.spark, "facts")
    for _ in range(2):
        detect.store(d.logs, d.assets, d.iocs, d.cves, RULES, path, "job")
    kept = commits.counts(d.spark, path)
    rows = [tables.read_table(d.spark, t, f"{path}/{t}").agg(F.lit(t).alias("fact"), F.count("*").alias("n"), F.lit(kept[t][""]).cast("long").alias("counted")) for t in FACTS]
    return reduce(DataFrame.unionByName, rows)


#: Where the tables that the dashboard polls have been stored, by session and folder.
POLLED: dict[tuple[str, str], str] = {}


def polled(d: Data) -> str:
    """The dashboard's tables as committed facts: stored once a session, and read by every poll after that."""
    key = (d.spark.sparkContext.applicationId, d.dir)
    if key not in POLLED:
        path = scratch_path(d.spark, "polled")
        tables.write_facts({"alerts": detect.alerts(matched(d))}, path)
        for part in (0, 1):
            own = {"incidents": d.incidents, "assets": d.assets, "cloud_findings": d.cloud, "endpoint_telemetry": d.endpoint, "phishing_analyses": d.mails.select(F.col("mail_id").alias("analysis_id"))}
            tables.write_facts({t: df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(2)) == part) for t, df in own.items()}, path)
        # every tenth incident is resolved, and open again: counts follow changes
        changed = d.incidents.where("cast(incident_id as bigint) % 10 = 0").select(F.col("status").alias("before"), F.lit("resolved").alias("after"))
        commits.count_changes(changed, path, "incidents", "status", "there")
        commits.count_changes(changed.select(F.col("after").alias("before"), F.col("before").alias("after")), path, "incidents", "status", "back")
        POLLED[key] = path
    return POLLED[key]


@query()
def kept_metrics(d: Data) -> DataFrame:
    """The dashboard's metrics from kept counts."""
    return feeds.kept_metrics(d.spark, polled(d), {"assets": "assets", "cloud": "cloud_findings", "endpoint": "endpoint_telemetry", "phishing": "phishing_analyses"})


@query()
def kept_cards(d: Data) -> DataFrame:
    return feeds.kept_cards(d.spark, polled(d))


SQL |= {"kept_metrics": SQL["dashboard_metrics"], "kept_cards": SQL["kpi_cards"]}


@query("select alert_id, ts from alert_fact order by ts desc nulls last, alert_id desc limit 250 offset 50", {"alert_fact": ALERTS_SQL} | NORM)
def stored_page(d: Data) -> DataFrame:
    """A page of the stored alerts after the newest 50."""
    rows = commits.read_runs(d.spark, "alerts", polled(d), "alert_id string, ts timestamp, event_date date")
    last = feeds.stored_page(rows, "ts", "alert_id", 50).collect()[-1]
    page = feeds.stored_page(rows, "ts", "alert_id", 250, (last.ts, last.alert_id))
    return page.select("alert_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


# ---- streams: the whole table as a stream that is read to its end ---------------------------------------------------


def streamed(d: Data, df: DataFrame, label: str, batches: int = 1) -> DataFrame:
    """`df`, its ts as an instant, as a stream: one batch of all its rows, or several that follow each other in time, each of the same number of files."""
    path, df = scratch_path(d.spark, label), df.withColumn("ts", F.col("ts").cast("timestamp"))
    if batches == 1:
        df.write.parquet(path)
        return d.spark.readStream.schema(df.schema).parquet(path)
    span = df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if span.a is None:
        return streamed(d, df, label)
    ends = [span.a + (span.b - span.a) * i / batches for i in range(batches)]
    of = lambda k: (F.col("ts") >= F.lit(ends[k])) & (F.col("ts") < F.lit(ends[k + 1])) if k + 1 < batches else F.col("ts").isNull() | (F.col("ts") >= F.lit(ends[k]))
    least = min(df.agg(*[F.count_if(of(k)) for k in range(batches)]).first())
    # rows are dealt in turn, so where a split has as many rows as there are files, each file gets some: none is missing
    files = max(1, min(2 * d.spark.sparkContext.defaultParallelism, least // max(1000, df.rdd.getNumPartitions())))
    for k in range(batches):
        own = df.where(of(k))
        (own.repartition(files) if files > 1 else own.coalesce(1)).write.mode("append").parquet(path)
    return d.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, d: Data, label: str) -> DataFrame:
    path = scratch_path(d.spark, label)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("select distinct event_id, ts from logs")
def stream_dedupe(d: Data) -> DataFrame:
    twice = d.logs.select("event_id", "ts").unionByName(d.logs.select("event_id", "ts").where("event_id % 3 = 0"))
    return drained(normalize.dedupe_event_id(streamed(d, twice, "twice"), "1 hour"), d, "once").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def delayed(events: DataFrame) -> list[DataFrame]:
    """`events` in four batches that follow each other in time, with the usual delay: rows of the half hour before a batch's end come with the next batch, and a last row lets the rest be counted."""
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span.b - span.a) / 3
    ends = [span.a, span.a + step, span.a + 2 * step, span.b]  # three steps are rounded, so the last one ends where the rows do
    end = events.sparkSession.range(1).select(F.lit("end").alias("event_id"), F.lit("end").alias("username"), F.lit(span.b + step).alias("ts"))
    late = lambda k: F.col("ts").between(F.lit(ends[k] - step / 400), F.lit(ends[k])) & (F.crc32("event_id") % 2 == 0) if k else F.lit(False)
    own = [events.where((F.col("ts") >= F.lit(ends[k])) & (F.col("ts") < F.lit(ends[k + 1])) & ~late(k + 1) | late(k)) for k in range(3)]
    return [*own, events.where(late(3) | (F.col("ts") == F.lit(span.b))).unionByName(end)]


@query("select cast(event_id as string) as event_id, count(*) over (partition by user_id order by ts range between interval 720 minutes preceding and current row) - (count(*) over (partition by user_id, ts) - row_number() over (partition by user_id, ts order by cast(event_id as string))) as n from events where user_id is not null")
def stream_threshold(d: Data) -> DataFrame:
    """With the usual delay: some rows come with the batch after theirs."""
    events = d.events.selectExpr("cast(event_id as string) as event_id", "cast(user_id as string) as username", "cast(ts as timestamp) as ts")
    path = scratch_path(d.spark, "late")
    for own in delayed(events):
        own.coalesce(1).write.mode("append").parquet(path)
    stream = d.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return drained(detect_stream.stream_threshold(stream, "username", 720), d, "counts").where("event_id != 'end'").select("event_id", "n")


@query("select alert_id, severity, status from alert_fact", STATED_ALERTS)
def stream_detect(d: Data) -> DataFrame:
    """The logs in several batches through the detection job: thresholds look back over what earlier batches stored."""
    path = scratch_path(d.spark, "job")
    detect_stream.stream_detect(streamed(d, d.logs, "raw", 4), d.assets, d.iocs, d.cves, RULES, path, f"{path}/state", once=True).awaitTermination()
    return tables.read_table(d.spark, "alerts", f"{path}/alerts").select("alert_id", "severity", "status")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources on the watch list are busy, and how sure are we: alerts of the detection job."""
    return QUERIES["alerts"](spark, sf_dir)
