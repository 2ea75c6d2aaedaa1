"""Security tables derived from the general tables by arithmetic on keys, in SQL that Spark and DuckDB both run.

`@name` stands for a table; a few expressions are spelled per engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


NAME = r"(?<!\w)@(\w+)"


def ip(u: str) -> str:
    return f"case when {u} % 10 = 0 then concat('10.10.1.', {u} % 254 + 1) else concat({u} * 37 % 223 + 1, '.', {u} * 11 % 256, '.', {u} * 7 % 256, '.', {u} % 254 + 1) end"


#: Payloads that every hundred and first log holds instead of a usual one.
ODD = (
    None,
    "",
    '{"message":null,"log":"x 1.2.3.4","severity":"high"}',
    '{"message":"br',
    "[1,2]",
    "7",
    "A:B from 1.2.3.4",
    "<34>Oct  1 22:14:15 mymachine su: failed for lonvick from 999.1.1.1 10.0.0.1",
    "2024-01-01T00:00:00 HOST-3 app: Login failed",
    '{"message":"ok","sourceIp":"","host":"HOST-7","dst_port":"22d","category":"odd"}',
    '{"event":"sudo for root from 10.1.1.1 then 10.1.1.1","message":null}',
    '  {"message":" user=u1 ","eventType":"port_scan","username":null,"user":"u7"} ',
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class Spelling:
    """What the two engines spell differently."""

    def __init__(self, duck: bool):
        self.duck = duck
        self.syslog_time = "strftime(ts, '%b %d %H:%M:%S')" if duck else "date_format(ts, 'MMM dd HH:mm:ss')"

    def before(self, days: str) -> str:
        return f"(date '2024-01-01' - cast({days} as int))" if self.duck else f"date_sub(date '2024-01-01', cast({days} as int))"

    def service(self, port: str, service: str, product: str, version: str) -> str:
        fields = (("port", f"cast({port} as int)"), ("service", service), ("product", product), ("version", version), ("banner", "''"))
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields) + ")" if self.duck else "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + ")"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def series(self, upto: str) -> str:
        return f"unnest(range(1, cast({upto} as bigint) + 1))" if self.duck else f"explode(case when {upto} > 0 then sequence(1L, {upto}) else array() end)"

    def later(self, hours: str) -> str:
        return f"(cast(o_orderdate as timestamp) + to_hours(cast({hours} as int)))" if self.duck else f"(cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, cast({hours} as int)))"

    @property
    def ts_type(self) -> str:
        return "timestamp" if self.duck else "timestamp_ntz"


def texts(s: Spelling) -> dict[str, str]:
    u = "user_id"
    message = f"""case event_type when 'error' then concat('Failed password for invalid user u', {u}, ' from ', {ip(u)}, ' port ', 1024 + event_id % 60000, ' ssh2')
        when 'click' then concat('powershell EncodedCommand started user=u', {u}, ' towards ', {ip(u)})
        when 'view' then concat('nmap port scan from ', {ip(u)}, ' to 10.0.0.', {u} % 254 + 1)
        when 'signup' then concat('email urgent action, username: u', {u})
        else concat('session opened for u', {u}, ' from ', {ip(u)}) end"""
    odd = " ".join(f"when {k} then {'null' if v is None else quoted(v)}" for k, v in enumerate(ODD, 1))
    return {
        "messages": f"select *, {message} as msg, {ip(u)} as addr from @events",
        "usual_logs": f"""select cast(event_id as string) as event_id, ts, case event_id % 3 when 0 then 'syslog' when 1 then 'json' else 'raw' end as source_type,
            case event_id % 3 when 0 then concat({s.syslog_time}, ' host-', {u} % 100, ' app[', event_id % 900 + 100, ']: ', msg)
                when 1 then concat('{{"message":"', msg, '","src_ip":"', addr, '","dst_port":', event_id % 1024, ',"host":"host-', {u} % 100, '","user":"u', {u}, '"}}') else msg end as usual,
            cast(null as bigint) as asset_id from @messages""".replace("{{", "{").replace("}}", "}"),
        "logs": f"""select event_id, ts, source_type, case event_id % 101 {odd} else usual end as payload, asset_id from (select *, cast(event_id as bigint) as number from @usual_logs) q""".replace("event_id % 101", "number % 101"),
        "assets": f"""select cast(s_suppkey as bigint) as id, concat('asset-', s_suppkey) as asset_id, concat('host-', s_suppkey) as hostname, {ip('s_suppkey')} as ip_address,
            case s_suppkey % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'medium' else 'low' end as criticality, concat('owner-', s_nationkey) as business_owner, 'production' as environment,
            {s.array(s.service('80', "'http'", "concat('brand#', s_suppkey % 5 + 1, s_nationkey % 5 + 1)", "'1.0'"), s.service('22', "'ssh'", "concat('openssh ', s_nationkey % 3)", "'7.2'"))} as services from @supplier""",
        "iocs": f"""select cast(c_custkey as bigint) as id, 'ip' as ioc_type, {ip('c_custkey')} as ioc_value,
            case c_mktsegment when 'AUTOMOBILE' then 'critical' when 'BUILDING' then 'high' when 'FURNITURE' then 'medium' else 'low' end as threat_level,
            cast(c_custkey % 100 as int) as confidence, {s.before('c_custkey')} as created_at from @customer where c_custkey % 7 = 3""",
        "cves": f"""select concat('CVE-2024-', lpad(cast(p_partkey as string), 5, '0')) as cve_id, concat('Flaw in ', p_name) as title, case when p_size > 40 then 'critical' when p_size > 20 then 'high' else 'low' end as severity,
            case when p_partkey % 50 = 0 then null else cast(p_partkey * 7 % 101 / 10 as decimal(3,1)) end as cvss_score,
            case when p_partkey % 2 = 0 then {s.array('lower(p_name)', 'lower(p_brand)')} else {s.array('lower(p_name)')} end as affected_products, {s.before('p_partkey')} as published_date, concat('About ', p_name) as description from @part""",
        "services": """select cast(l_orderkey as string) as scan_id, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) as position,
            cast(l_suppkey % 65535 + 1 as int) as port, lower(p_type) as service, lower(p_name) as product, cast(p_size as string) as version, cast(null as string) as banner from @lineitem join @part on l_partkey = p_partkey""",
        "scans": f"select cast(o_orderkey as string) as scan_id, concat('target-', o_custkey) as target_host, cast(o_orderdate as {s.ts_type}) as created_at from @orders",
        "iam": f"""select cast(event_id as string) as iam_event_id, ts, 'okta' as provider, concat('u', {u}) as actor, concat('action-', event_id % 5) as action, {ip(u)} as source_ip, cast(event_id % 100 as int) as anomaly_score from @events where event_type = 'signup'""",
        "endpoint": f"""select cast(event_id as string) as telemetry_id, ts, concat('host-', {u} % 100) as hostname, concat('u', {u}) as username, case event_id % 3 when 0 then 'PowerShell.exe' when 1 then 'cmd.exe' else '' end as process_name,
            {ip(u)} as destination_ip, case event_id % 2 when 0 then 'high' else 'medium' end as severity, concat('run ', event_id) as command_line from @events where event_type = 'click'""",
        "cloud": f"""select cast(event_id as string) as finding_id, ts, 'aws' as provider, concat('bucket-', {u}) as resource_id, case event_id % 2 when 0 then 's3' else '' end as service, 'public bucket' as finding_type, case event_id % 4 when 0 then 'critical' else 'medium' end as severity from @events where event_type = 'view'""",
        "mails": """select cast(doc_id as string) as mail_id, substring(text, 1, 60) as subject, case doc_id % 5 when 0 then 'security-alerts@company-support.xyz' when 1 then 'friend@example.org' when 2 then 'billing@shop.example' when 3 then 'news@site.ru' else 'colleague@work.example' end as sender,
            concat('user', doc_id % 50, '@corp.example') as recipient, concat(text, case doc_id % 7 when 0 then ' please verify your account at http://x.example/a and HTTPS://y.example/b)' when 1 then ' enable content' when 2 then ' see https://z.example' when 3 then ' WIRE TRANSFER now' else '' end) as body, cast(doc_id % 3 as int) as attachment_count from @documents""",
        "incidents": f"""select cast(o_orderkey as string) as incident_id, concat('Case ', o_orderkey) as title, case o_orderkey % 4 when 0 then 'open' when 1 then 'investigating' when 2 then 'contained' else 'resolved' end as status,
            case substring(o_orderpriority, 1, 1) when '1' then 'critical' when '2' then 'high' when '3' then 'medium' else 'low' end as severity, cast(o_orderdate as {s.ts_type}) as created_at, cast(o_orderdate as {s.ts_type}) as updated_at from @orders""",
        "updates": f"""select concat(incident_id, '-', k) as update_id, incident_id, case k % 4 when 0 then 'open' when 1 then 'investigating' when 2 then 'contained' else 'resolved' end as status, ts, k as user from
            (select cast(o_orderkey as string) as incident_id, k, {s.later('k')} as ts from (select o_orderkey, o_orderdate, {s.series('o_orderkey % 4')} as k from @orders) q) r""",
        "evidence": """select cast(doc_id as bigint) as id, cast(doc_id % 200 as string) as incident_id, concat('doc-', doc_id) as filename, cast(n_chars as bigint) as file_size, text from @documents""",
        "custody": """select concat(conv_id, '-', turn) as custody_event_id, cast(conv_id * 13 as bigint) as evidence_id, role as action, cast(turn as bigint) as turn from @conversations""",
        "entries": "select concat('t', event_id) as timeline_id, cast(event_id % 200 as string) as incident_id, event_type as event_description, ts as event_ts from @events",
        "found": f"select concat('a', p_partkey) as artifact_id, cast(p_partkey % 200 as string) as incident_id, p_name as title, {s.before('p_partkey')} as created_at from @part",
        "audit": "select cast(conv_id % 200 as string) as incident_id, role as action, cast(turn as bigint) as turn, cast(conv_id as bigint) as conv_id from @conversations",
        "honeypots": "select cast(r_regionkey as bigint) as id, concat('pot-', r_name) as name, 'ssh' as service_type, cast(0 as int) as interaction_count from @region",
        "interactions": f"select concat('i', event_id) as interaction_id, cast(event_id % 5 as bigint) as honeypot_id, {ip(u)} as attacker_ip, ts from @events where event_type = 'error'",
        "actors": "select cast(n_nationkey as bigint) as id, n_name as name, cast(n_nationkey * 7 % 11 as int) as known_incidents from @nation",
        "entered": "select cast(event_id as string) as detection_id, cast(event_id % 9 as bigint) as rule_id, cast(event_id % 101 as int) as confidence, ts from @events",
        "playbooks": f"""select cast(n_nationkey as bigint) as id, concat('Playbook ', n_name) as name, {s.array(*[("struct_pack(name := {0}, action := {1})" if s.duck else "named_struct('name', {0}, 'action', {1})").format(n, a) for n, a in (("'Ticket'", "'create-ticket'"), ("cast(null as string)", "case n_regionkey when 0 then 'contain-host' when 1 then 'disable-user' else 'notify' end"), ("'Watch'", "cast(null as string)"))])} as steps from @nation""",
        "executions": "select cast(o_orderkey as string) as execution_id, cast(o_custkey % 30 as bigint) as playbook_id, case when o_orderkey % 3 = 0 then null else cast(o_orderkey as string) end as incident_id from @orders",
        "links": "select concat('al', l_orderkey) as alert_id, cast(max(l_suppkey) as string) as incident_id from @lineitem where l_orderkey % 5 = 0 group by l_orderkey",
        "alert_rows": "select concat('al', o_orderkey) as alert_id, case when o_orderkey % 2 = 0 then cast(o_custkey as string) end as incident_id from @orders",
    }


#: Derived tables that have been stored, by folder and name: what is timed on them does not include making them.
STORED: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str, names: list[str], path: str) -> None:
    """Write derived tables of `sf_dir` under `path`; Data reads them from there from now on."""
    for name in names:
        getattr(Data(spark, sf_dir), name).write.parquet(f"{path}/{name}")
        STORED[sf_dir, name] = f"{path}/{name}"


class Data:
    """The general and derived tables of one folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    @cached_property
    def texts(self) -> dict[str, str]:
        return texts(Spelling(False))

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name not in self.texts:
            raise AttributeError(name)
        if (self.dir, name) in STORED:
            return self.spark.read.parquet(STORED[self.dir, name])
        if name not in self.made:
            text = self.texts[name].replace("{", "{{").replace("}", "}}")
            used = {t for t in re.findall(NAME, text) if t in BASE or t in self.texts}
            self.made[name] = self.spark.sql(re.sub(NAME, lambda m: f"{{{m[1]}}}" if m[1] in used else m[0], text), **{t: getattr(self, t) for t in used})
        return self.made[name]


SPELLED = texts(Spelling(True))
DUCK = {name: re.sub(NAME, lambda m: m[1] if m[1] in BASE or m[1] in SPELLED else m[0], text) for name, text in SPELLED.items()}


def duck(select: str, more: dict[str, str] | None = None) -> str:
    """A DuckDB query over derived tables (and further named queries, in order), as common table expressions that it needs."""
    known = DUCK | (more or {})
    need: list[str] = []

    def add(text: str) -> None:
        for word in re.findall(r"\w+", text):
            if word in known and word not in need and known[word] is not text:
                add(known[word])
                if word not in need:
                    need.append(word)

    add(select)
    return ("with " + ", ".join(f"{n} as ({known[n]})" for n in need) + " " if need else "") + select
