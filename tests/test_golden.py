"""Golden rows of the event model, its edge cases, and the demo scenario end to end."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sentrel.functions import net, scoring
from sentrel.functions import text as T
from sentrel.operators import cases, detect, domains, enrich, feeds, normalize, phishing, rules, vuln
from sentrel.sources import schemas, tables

LOGS = "event_id string, ts timestamp, source_type string, payload string, asset_id long"
T0 = dt.datetime(2024, 4, 10, 12, 0, 1)


def logs(spark, *payloads, kind="syslog"):
    return spark.createDataFrame([(f"e{i}", T0 + dt.timedelta(seconds=61 * i), kind, p, None) for i, p in enumerate(payloads)], LOGS)


def first(df):
    return df.orderBy("event_id").collect()[0]


def test_syslog_line(spark):
    r = first(normalize.normalize_events(logs(spark, "Apr 10 12:00:01 web-01 sshd[101]: Failed password for invalid user admin from 91.240.118.12 port 49222 ssh2")))
    assert (r.event_type, r.event_category, r.source_ip, r.hostname, r.username, r.severity) == ("authentication_failed", "identity", "91.240.118.12", "web-01", "admin", "medium")


def test_json_object_keeps_its_fields(spark):
    p = '{"eventType":"suspicious_process","eventCategory":"endpoint","sourceIp":"10.0.0.5","destinationIp":"8.8.8.8","hostname":"ws-001","username":"alex","message":"odd","severity":"high","src_port":" 22 ","dst_port":"22d"}'
    r = first(normalize.normalize_events(logs(spark, p, kind="json")))
    assert (r.event_type, r.source_ip, r.destination_ip, r.hostname, r.username, r.severity, r.source_port, r.destination_port) == ("suspicious_process", "10.0.0.5", "8.8.8.8", "ws-001", "alex", "high", 22, None)


def test_odd_payloads(spark):
    odd = [None, "", "7", "[1]", "null", '{"message":null,"log":"x"}', "from 1.2.3.4", "999.1.1.1 seen", "no colon here", "2024-01-01T00:00:00 host app: hi", "a: b\n"]
    for kind in ("raw", "json", "syslog"):
        rows = {r.event_id: r for r in normalize.normalize_events(logs(spark, *odd, kind=kind)).collect()}
        assert len(rows) == len(odd) and all(r.event_type == "generic_security_event" for r in rows.values())
    rows = {r.event_id: r for r in normalize.normalize_events(logs(spark, *odd, kind="raw")).collect()}
    assert (rows["e6"].source_ip, rows["e6"].destination_ip) == ("1.2.3.4", "1.2.3.4")  # message and payload both hold it
    assert rows["e7"].source_ip == "999.1.1.1"


@pytest.mark.parametrize(
    ("ip", "country"),
    [("63.1.1.1", "United States"), ("64.1.1.1", "Germany"), ("127.0.0.1", "internal"), ("128.1.1.1", "Singapore"), ("191.1.1.1", "Singapore"), ("192.1.1.1", "Australia"), ("172.15.0.1", "Singapore"), ("172.16.0.1", "internal"), ("172.31.0.1", "internal"), ("172.32.0.1", "Singapore"), ("x.y", "Australia"), ("", None), (None, None)],
)
def test_places(spark, ip, country):
    r = spark.createDataFrame([(ip,)], "ip string").select(net.geo_lookup(F.col("ip")).alias("g"), net.is_private_ip(F.col("ip")).alias("p")).first()
    assert (r.g.country if r.g else None) == country and r.p == (country == "internal")


def test_ports_and_scores(spark):
    got = spark.createDataFrame([("22",), (" 22 ",), ("22d",), ("x",), ("",), (None,)], "v string").select(T.extract_port(F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == [22, 22, None, None, None, None]
    got = spark.createDataFrame([(9.0,), (7.0,), (4.0,), (3.9,), (None,)], "v double").select(scoring.cvss_severity(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == ["critical", "high", "medium", "low", "medium"]
    assert spark.range(1).select(scoring.content_hashes(F.lit("abc"))["sha512_hash"].alias("h")).first().h.startswith("ddaf35a1")


def scenario(spark, hostname):
    lines = [f"Apr 10 12:0{i}:0{i + 1} web-01 sshd[1]: Failed password for {u} from 91.240.118.12 port 4922{i} ssh2" for i, u in enumerate(("invalid user admin", "invalid user admin", "root"))]
    service = [(443, "https", "apache", "2.4.49", ""), (22, "ssh", "openssh", "7.2", "")]
    assets = spark.createDataFrame([(1, "a1", hostname, "10.10.1.25", "critical", "ops", "production", service)], "id long, asset_id string, hostname string, ip_address string, criticality string, business_owner string, environment string, services array<struct<port:int,service:string,product:string,version:string,banner:string>>")
    iocs = spark.createDataFrame([(1, "ip", "91.240.118.12", "high", 85), (2, "ip", "91.240.118.12", "low", 5)], "id long, ioc_type string, ioc_value string, threat_level string, confidence int")
    cves = spark.createDataFrame([("CVE-1", "t", "high", 9.8, ["Apache"], T0), ("CVE-2", "t", "low", None, [], None), ("CVE-3", "t", "low", None, [""], None), ("CVE-4", "t", "low", None, None, T0)], "cve_id string, title string, severity string, cvss_score double, affected_products array<string>, published_date timestamp")
    logic = '{"eventTypes":["authentication_failed"],"allKeywords":["failed","ssh"],"matchIoc":true,"threshold":{"field":"sourceIp","count":3,"windowMinutes":15},"assetCriticalities":["critical","high"]}'
    docs = spark.createDataFrame([(1, "r1", "SSH brute force", True, logic, None, "high", "T1110", "Credential Access", None, None, 60, T0), (2, "r2", "off", False, "{}", None, "low", None, None, None, None, None, T0)], "id long, rule_id string, rule_name string, enabled boolean, detection_logic string, pattern string, severity string, attack_technique string, attack_tactic string, threshold_count int, threshold_window_minutes int, confidence_weight int, updated_at timestamp")
    return logs(spark, *lines), assets, iocs, cves, rules.load_rules(docs)


def test_scenario_as_seeded(spark):
    raw, assets, iocs, cves, loaded = scenario(spark, "web-01.prod.internal")
    events = enrich.enrich_events(normalize.normalize_events(raw), assets, iocs, cves)
    rows = events.orderBy("event_id").collect()
    assert [r.username for r in rows] == ["admin", "admin", "root"] and all(len(r.ioc_hits) == 2 and r.enrichment.geo.source.city == "Frankfurt" for r in rows)
    assert rules.evaluate_rules(events, loaded).count() == 0


def test_scenario_with_known_host(spark, tmp_path):
    raw, assets, iocs, cves, loaded = scenario(spark, "WEB-01")
    matches = detect.ingest(raw, assets, iocs, cves, loaded).cache()
    r = matches.collect()[0]
    assert matches.count() == 1 and r.event_id == "e2" and r.match.confidence == 99 and len(r.match.reasons) == 3
    assert r.match.reasons[2] == "Threshold met on sourceIp: 3/3 in 15m"
    whole = enrich.enrich_events(normalize.normalize_events(raw), assets, iocs, cves).first()
    assert [c.cve_id for c in whole.enrichment.cve_candidates] == ["CVE-1", "CVE-3"]
    out = detect.outputs(matches)
    alert, incident = out["alerts"].first(), out["incidents"].first()
    assert alert.status == "triaged" and alert.incident_id == incident.incident_id and incident.severity == "high" and incident.affected_assets == ["WEB-01"]
    tables.write_facts({"security_events": normalize.normalize_events(raw), **out}, str(tmp_path))
    for name in ("security_events", "alerts", "ids_detections", "incidents", "incident_audit_trail"):
        back = tables.read_table(spark, name, f"{tmp_path}/{name}")
        assert back.count() == (3 if name == "security_events" else 1) and back.columns[: len(schemas.schema(name))] == schemas.schema(name).fieldNames()


def test_threshold_brute_force(spark):
    draw = random.Random(7)
    rows = [(f"e{i:03}", T0 + dt.timedelta(minutes=draw.choice([0, 5, 15, 15, 20, 31, 45, 400]) + draw.randrange(40)), draw.choice(["a", "b", None, ""])) for i in range(160)]
    got = {r.event_id: r.n for r in rules.threshold_window(spark.createDataFrame(rows, "event_id string, ts timestamp, source_ip string"), "source_ip", 15, "n").collect()}
    for e, t, k in rows:
        want = sum(k == k2 and (t - dt.timedelta(minutes=15) <= t2 < t or (t2 == t and e2 <= e)) for e2, t2, k2 in rows) if k else 1
        assert got[e] == want


def test_thresholds_count_repeated_ids_once_and_take_the_past(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    now = spark.createDataFrame([("a", at(10), "k"), ("a", at(10), "k"), ("b", at(15), "k"), ("c", at(16), "")], "event_id string, ts timestamp, source_ip string")
    past = spark.createDataFrame([("p", at(0), "k"), ("q", at(1), "k"), ("r", at(1), "z")], now.schema)
    counted = rules.sliding_counts(now, {"n": ("source_ip", rules.micros(), 15 * 60_000_000)}, past)
    assert sorted((r.event_id, r.n) for r in counted.collect()) == [("a", 3), ("a", 3), ("b", 4), ("c", 1)]


def test_rows_outside_an_enum_are_returned(spark, tmp_path):
    rows = spark.createDataFrame([("e1", "warning", T0), ("e2", "high", T0), ("e3", None, T0)], "event_id string, severity string, ts timestamp")
    assert [(r.event_id, r.reject_reason) for r in tables.rejected(rows, "security_events").collect()] == [("e1", "severity=warning")]
    tables.write_facts({"security_events": rows}, str(tmp_path))
    assert tables.read_table(spark, "security_events", f"{tmp_path}/security_events").count() == 2 and tables.read_rejected(spark, "security_events", f"{tmp_path}/security_events").count() == 1


def test_upserts_row_by_row(spark):
    target = spark.createDataFrame([("u", "old", "m"), ("v", "old", "m")], "k string, name string, mail string")
    updates = spark.createDataFrame([("u", None, "x", ["name"], 1), ("v", "new", None, ["mail", "name"], 1), ("w", "n", "y", ["mail"], 1)], "k string, name string, mail string, own array<string>, o int")
    got = {r.k: (r.name, r.mail) for r in tables.upsert_by_key(target, updates, "k", ["name", "mail"], "o", "own").collect()}
    assert got == {"u": (None, "m"), "v": ("new", None), "w": (None, "y")}


def test_newest_cves_by_product(spark):
    draw = random.Random(3)
    names = ["ab", "a", "", "openssh", "ssh 7", "apache", "tomcat", "cat"]
    cves = [(f"C{i:02}", None if i % 9 == 0 else T0 + dt.timedelta(days=draw.randrange(20)), [draw.choice(names) for _ in range(draw.randrange(3))]) for i in range(60)]
    texts = ["openssh 7.2 on ab", "apache tomcat", "zzz", "a", "SSH 7".lower()]
    got = enrich.matching_cves(spark.createDataFrame([(t,) for t in texts], "haystack string"), spark.createDataFrame(cves, "cve_id string, published_date timestamp, affected_products array<string>"), 3, []).collect()
    for t in texts:
        want = sorted((c for c in cves if any(p in t for p in c[2])), key=lambda c: (c[1] is None, -(c[1] or T0).timestamp(), c[0]))[:3]
        assert [r.cve_id for r in sorted(got, key=lambda r: r["rank"]) if r.haystack == t] == [c[0] for c in want]


def test_capped_threshold_brute_force(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    draw = random.Random(9)
    rows = [(f"e{i:03}", T0 + dt.timedelta(minutes=draw.randrange(60)), draw.choice(["a", "a", "b", None])) for i in range(150)]
    got = {r.event_id: r.n for r in rules.capped_threshold(spark.createDataFrame(rows, "event_id string, ts timestamp, source_ip string"), "source_ip", 15, "n", recent=20).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for i, (e, t, k) in enumerate(ordered):
        want = 1 + sum(k == k2 and t2 >= t - dt.timedelta(minutes=15) for _, t2, k2 in ordered[max(0, i - 20) : i]) if k else 1
        assert got[e] == want


def test_raw_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo\n")
    rows = tables.read_raw_logs(spark, str(tmp_path), "syslog").collect()
    assert {r.payload for r in rows} == {"one", "two"} and len({r.event_id for r in rows}) == 2
    with pytest.raises(ValueError):
        tables.read_raw_logs(spark, str(tmp_path), "other")


def test_equal_lines_are_events_of_their_own(spark, tmp_path):
    line = "Failed password for root from 9.9.9.9"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join([line] * 5 + [f"other {i}" for i in range(300)] + [line] * 2) + "\n")
    (tmp_path / "in/b.log").write_text("\r\n".join([line] * 5) + "\r\n")
    read = lambda **more: tables.read_raw_logs(spark, f"{tmp_path}/in", "syslog", split_bytes=500, **more)
    rows = read()
    assert rows.rdd.getNumPartitions() > 3
    ids = {r.event_id: r.payload for r in rows.collect()}
    assert len(ids) == 312 and list(ids.values()).count(line) == 12
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")  # another cluster deals files out otherwise
    try:
        assert {r.event_id for r in read().collect()} == set(ids)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    query = read(stream=True).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()} == set(ids)
    events = normalize.dedupe_event_id(normalize.normalize_events(rows))
    assert {r.n for r in rules.threshold_window(events.where("source_ip = '9.9.9.9'"), "source_ip", 5, "n").collect()} >= {1, 2, 3, 4, 5}


def test_small_splits_share_tasks_and_name_lines_as_before(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text("".join(f"line {i % 7}\n" for i in range(4000)))
    read = lambda: tables.read_raw_logs(spark, str(tmp_path), "raw", split_bytes=300)
    rows = read()
    assert rows.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    ids = {r.event_id: r.payload for r in rows.collect()}
    assert len(ids) == 4000
    monkeypatch.setattr(tables, "SPLIT_BYTES", 300)  # a task for each split
    alone = read()
    assert alone.rdd.getNumPartitions() > 90 and {r.event_id: r.payload for r in alone.collect()} == ids


def test_upsert_overwrites_with_null(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, mail string")
    new = spark.createDataFrame([(1, "old", 1), (1, None, 2), (3, "c", 1)], "id long, name string, o long")
    got = {r.id: (r.name, r.mail) for r in tables.upsert_by_key(target, new, "id", ["name"], "o").collect()}
    assert got == {1: (None, "x"), 2: ("b", "y"), 3: ("c", None)}


def test_rules_put_aside_and_empty(spark):
    good, bad = rules.usable(spark, [rules.Rule(1, "a", "A", logic={"rawRegex": "("}), rules.Rule(2, "b", "B")])
    assert [r.rule_id for r in good] == ["b"] and bad[0][0] == "a"
    raw, assets, iocs, cves, _ = scenario(spark, "web-01")
    events = enrich.enrich_events(normalize.normalize_events(raw), assets, iocs, cves)
    assert rules.evaluate_rules(events, []).count() == 0
    r = rules.evaluate_rules(events, [rules.Rule(2, "b", "B", logic={})]).collect()
    assert len(r) == 3 and r[0].match.reasons == ["Matched Sigma-like logic for B"]
    empty = rules.evaluate_rules(enrich.enrich_events(normalize.normalize_events(raw.limit(0)), assets.limit(0), iocs.limit(0), cves.limit(0)), [rules.Rule(2, "b", "B")])
    assert empty.count() == 0


def test_mail(spark):
    mails = spark.createDataFrame([("m1", "Urgent: verify your payroll account", "security-alerts@company-support.xyz", "r", "see http://x.example/a now", 0), ("m2", None, None, None, None, None), ("m3", "s", "billing@x", "r", "b", 0)], "mail_id string, subject string, sender string, recipient string, body string, attachment_count int")
    rows = {r.analysis_id: r for r in phishing.analyze(mails).collect()}
    assert (rows["m1"].verdict, rows["m1"].confidence, len(rows["m1"].reasons), len(rows["m1"].indicators)) == ("malicious", 80, 3, 2)
    assert (rows["m2"].score, rows["m2"].verdict) == (35, "benign") and (rows["m3"].score, rows["m3"].verdict) == (55, "suspicious")


def test_feeds(spark):
    iam = spark.createDataFrame([("i1", T0, "okta", "jdoe", "login", "8.8.8.8", 82), ("i2", T0, "okta", "jdoe", "login", "8.8.8.8", 74)], "iam_event_id string, ts timestamp, provider string, actor string, action string, source_ip string, anomaly_score int")
    assert [(r.event_type, r.severity) for r in domains.iam_to_events(iam).orderBy("event_id").collect()] == [("suspicious_login", "high"), ("authentication_failed", "medium")]


def test_cases(spark):
    books = spark.createDataFrame([(1, "B", [("create", "create-ticket"), ("contain", "contain-host"), (None, None)])], "id long, name string, steps array<struct<name:string,action:string>>")
    runs = spark.createDataFrame([("x1", 1, "c1"), ("x2", 1, None), ("x3", 9, "c1")], "execution_id string, playbook_id long, incident_id string")
    done = cases.playbook_expand(runs, books)
    out = {r.execution_id: r.output for r in done.collect()}
    assert [(s.step, s.name, s.action) for s in out["x1"]] == [(1, "create", "create-ticket"), (2, "contain", "contain-host"), (3, "Step 3", "observe")] and out["x1"][0].note == "Ticket payload generated"
    assert cases.playbook_audit(done).count() == 1 and [r.execution_id for r in cases.unknown_playbooks(runs, books).collect()] == ["x3"]


def test_scan_rollup_without_findings(spark):
    scans = spark.createDataFrame([("s1", None), ("s2", [(80, "http", None, None, None)])], "scan_id string, target_services array<struct<port:int,service:string,product:string,version:string,banner:string>>")
    cves = spark.createDataFrame([("C1", ["http"], None, None)], "cve_id string, affected_products array<string>, cvss_score double, published_date timestamp")
    found = vuln.findings(vuln.cve_service_match(vuln.observed(scans), cves))
    assert found.first().title == "http exposure mapped to C1"
    got = {r.scan_id: (r.vulnerabilities_found, r.medium_count, float(r.risk_score)) for r in vuln.scan_rollup(scans, found).collect()}
    assert got == {"s1": (0, 0, 0.0), "s2": (1, 1, 3.0)}


def test_appends_conform(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "b", "public", None), ("f2", "b", "public", "odd")], "finding_id string, resource_id string, finding_type string, severity string")
    tables.append_rows(rows, "cloud_findings", f"{tmp_path}/c")
    r = tables.read_table(spark, "cloud_findings", f"{tmp_path}/c").collect()
    assert len(r) == 1 and (r[0].provider, r[0].severity, r[0].status) == ("aws", "medium", "open")
    assert all(tables.conformed(spark.createDataFrame([], "nothing int"), t).columns == schemas.schema(t).fieldNames() for t in schemas.TABLES)


def test_search_takes_wildcards(spark):
    iocs = spark.createDataFrame([(1, "Evil.Example"), (2, "good")], "id long, ioc_value string")
    assert [r.id for r in feeds.search_ioc(iocs, "evil_ex").collect()] == [1]


def test_all_digests_of_a_table(spark, sf_dir):
    import hashlib

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for r in docs.select("text", *[c.alias(n) for n, c in scoring.content_hashes(F.col("text")).items()]).collect():
        for name in ("md5", "sha1", "sha256", "sha512"):
            assert r[f"{name}_hash"] == (None if r.text is None else hashlib.new(name, r.text.encode()).hexdigest())
