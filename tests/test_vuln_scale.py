"""What moves when services meet CVEs."""

import hashlib
import json

from pyspark.sql import functions as F

from sentrel.operators import vuln


def tables(spark):
    services = spark.range(40).selectExpr("cast(id div 4 as string) as scan_id", "cast(id % 4 as int) as position", "80 as port", "'http' as service", "case when id % 3 = 0 then '' else concat('Prod', id % 5) end as product", "'1' as version", "cast(null as string) as banner")
    cves = spark.range(12).selectExpr("concat('CVE-', id) as cve_id", "cast(id as decimal(3,1)) as cvss_score", "array(concat('prod', id % 4)) as affected_products", "date_sub(date '2024-01-01', cast(id as int)) as published_date")
    return services, cves


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_services_stay_where_few_texts_match(spark):
    services, cves = tables(spark)
    found = vuln.findings(vuln.cve_service_match(services, cves))
    assert "BroadcastHashJoin" in plan(found) and "Exchange hashpartitioning" not in plan(found)
    assert found.count() == sum(3 for i in range(40) if i % 3 and i % 5 < 4)


def test_a_service_moves_once_to_its_scan_and_without_ids(spark):
    services, cves = tables(spark)
    scans = spark.range(12).selectExpr("cast(id as string) as scan_id")
    results = vuln.scan_results(scans, vuln.service_matches(services, cves), F.lit(None))
    moved = [line for line in plan(results).splitlines() if "Exchange hashpartitioning(scan_id" in line]
    assert moved and all("sha2" not in part for part in plan(results).split("Exchange hashpartitioning(scan_id")[1:])
    want: dict[str, list] = {str(i): [] for i in range(12)}
    for r in vuln.findings(vuln.cve_service_match(services, cves)).collect():
        want[r.scan_id].append((r.vulnerability_id, {"cveId": r.cve_id, "severity": r.severity, "title": r.title}))
    got = {r.scan_id: json.loads(r.results)["matchedFindings"] for r in results.collect()}
    assert got == {k: [f for _, f in sorted(v, key=lambda x: x[0])] for k, v in want.items()}
    for id_, f in want["0"]:
        assert id_ in {hashlib.sha256(f"0:{p}:{f['cveId']}".encode()).hexdigest() for p in range(4)}
