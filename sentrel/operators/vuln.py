"""Observed services against CVEs: findings and the roll-up of each scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import cvss_severity, risk_of, stable_id
from ..functions.text import or_null
from ..sources.scratch import written
from .enrich import matching_cves


def service_haystack(service: Column, product: Column, version: Column, banner: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.lower(F.concat(service, F.lit(" "), part(product), F.lit(" "), part(version), F.lit(" "), part(banner)))


def observed(scans: DataFrame) -> DataFrame:
    """(scan_id, position, port, service, product, version, haystack): one row a service."""
    rows = scans.select("scan_id", F.posexplode("target_services").alias("position", "s"))
    return rows.select("scan_id", "position", "s.port", "s.service", "s.product", "s.version", service_haystack(F.col("s.service"), F.col("s.product"), F.col("s.version"), F.col("s.banner")).alias("haystack"))


def service_matches(services: DataFrame, cves: DataFrame, k: int = 3) -> DataFrame:
    """Services that match, a row each, with `cves`: their k newest CVEs (cve_id, cvss_score, description) in order of rank.

    CVEs are found once a distinct haystack and written (spark.checkpoint.dir), so that Spark knows their size:
    services move for them only where they are too many to be broadcast. Services without `haystack` have it made of
    service, product, version and banner; its text is then no column that moves beside these.
    """
    stated = cves if "description" in cves.columns else cves.withColumn("description", F.lit(None).cast("string"))
    text = F.col("haystack") if "haystack" in services.columns else service_haystack(*map(F.col, ("service", "product", "version", "banner")))
    found = matching_cves(services.select(text.alias("haystack")), stated, k, ["cvss_score", "description"])
    listed = found.groupBy(F.col("haystack").alias("__text")).agg(F.array_sort(F.collect_list(F.struct("rank", "cve_id", "cvss_score", "description"))).alias("cves"))
    return services.join(written(listed, "cves"), text == F.col("__text")).drop("__text")


def cve_service_match(services: DataFrame, cves: DataFrame, k: int = 3) -> DataFrame:
    """Services with their k newest CVEs, a row each: ranked once a distinct haystack, then mapped back."""
    return service_matches(services, cves, k).select("*", F.inline("cves")).drop("cves")


def exposed() -> Column:
    """What a finding calls the service."""
    return F.coalesce(or_null(F.col("product")), F.col("service"))


def title_of(name: Column, cve_id: Column) -> Column:
    return F.concat(name, F.lit(" exposure mapped to "), cve_id)


def findings(matched: DataFrame) -> DataFrame:
    """One row a match; the wordings are fixed values."""
    name = exposed()
    return matched.select(
        stable_id("scan_id", "position", "cve_id").alias("vulnerability_id"), "scan_id", "cve_id", title_of(name, F.col("cve_id")).alias("title"), "description",
        cvss_severity(F.col("cvss_score")).alias("severity"), name.alias("affected_service"), F.col("port").alias("affected_port"),
        F.concat(F.lit("Validate version "), F.coalesce(or_null(F.col("version")), F.lit("unknown")), F.lit("; patch or mitigate according to "), "cve_id", F.lit(".")).alias("remediation_steps"), F.lit("open").alias("status"),
    )


def execution_mode(services: Column) -> Column:
    return F.when(F.coalesce(F.size(services), F.lit(0)) > 0, "evidence-driven").otherwise("simulation")


def scan_rollup(scans: DataFrame, found: DataFrame) -> DataFrame:
    """Counts by severity and the risk of every scan; 0 for scans without findings. `risk_small` is the risk where it fits two digits after three, else null."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}_count")
    sums = found.groupBy("scan_id").agg(F.count("*").alias("vulnerabilities_found"), *map(count, ("critical", "high", "medium", "low")), F.sum(risk_of(F.col("severity"))).alias("risk"))
    joint = scans.select("scan_id").join(sums, "scan_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    risk = F.coalesce("risk", F.lit(0))
    return joint.select("scan_id", *map(zero, ("vulnerabilities_found", "critical_count", "high_count", "medium_count", "low_count")), risk.cast("decimal(12,2)").alias("risk_score"), risk.try_cast("decimal(5,2)").alias("risk_small"), F.lit("completed").alias("status"))


def scan_results(scans: DataFrame, matches: DataFrame, ended: Column) -> DataFrame:
    """(scan_id, end_time, results): what a finished scan keeps of its `service_matches`, its findings in the order of their ids as JSON; scans without findings have an empty list.

    A service moves to its scan once, with the ids and severities of its CVEs; ids and titles of findings are made there.
    """
    own = F.transform("cves", lambda c: F.struct(c["cve_id"].alias("cve_id"), cvss_severity(c["cvss_score"]).alias("severity")))
    held = matches.groupBy("scan_id").agg(F.collect_list(F.struct("position", exposed().alias("name"), own.alias("cves"))).alias("services"))
    made = lambda s: F.transform(s["cves"], lambda c: F.struct(stable_id(F.col("scan_id"), s["position"], c["cve_id"]).alias("id"), c["cve_id"].alias("cveId"), c["severity"].alias("severity"), title_of(s["name"], c["cve_id"]).alias("title")))
    shown = held.select("scan_id", F.array_sort(F.flatten(F.transform("services", made))).alias("f"))
    listed = F.transform("f", lambda x: F.struct(x["cveId"].alias("cveId"), x["severity"].alias("severity"), x["title"].alias("title")))
    empty = F.array().cast("array<struct<cveId:string,severity:string,title:string>>")
    return scans.select("scan_id").join(shown, "scan_id", "left").select("scan_id", ended.cast("timestamp").alias("end_time"), F.to_json(F.struct(F.coalesce(listed, empty).alias("matchedFindings"))).alias("results"))


def list_scans(scans: DataFrame, limit: int = 50) -> DataFrame:
    return scans.orderBy(F.col("created_at").desc(), F.col("scan_id").desc()).limit(limit)


def scan_vulnerabilities(found: DataFrame, scan_id: object) -> DataFrame:
    return found.where(F.col("scan_id") == scan_id)
