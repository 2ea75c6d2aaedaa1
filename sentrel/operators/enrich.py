"""Context for events: assets, indicators, places, candidate CVEs, techniques.

Joins carry no hints, so Spark broadcasts a side only while its measured size is under the session's threshold, and
splits skewed keys otherwise. Dimensions are reduced to one row a key first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.net import geo_band, geo_lookup
from ..functions.scoring import mitre_lookup
from ..functions.text import extract_ips, or_null
from .normalize import once

#: Up to so many assets are broadcast by their keys; beyond, Spark decides by size.
BROADCAST_ASSETS = 500_000
ASSET = ["id", "asset_id", "hostname", "ip_address", "criticality", "business_owner", "environment", "services"]
#: The candidate CVEs that enrich_events adds to an asset, so that they come with it.
CVES = "__cves"


def one_asset(assets: DataFrame, key, name: str) -> DataFrame:
    """The asset of the lowest id for each key, as a struct."""
    have = [c for c in (*ASSET, CVES) if c in assets.columns]
    return assets.select(key.alias(f"__{name}"), F.struct(*have).alias("a"), "id").where(F.col(f"__{name}").isNotNull()).groupBy(f"__{name}").agg(F.min_by("a", "id").alias(f"__{name}_asset"))


def asset_by_id(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Left join by an explicit asset id, as struct `asset`."""
    return events.join(one_asset(assets, F.col("id"), "id"), F.col("asset_id") == F.col("__id"), "left").withColumnRenamed("__id_asset", "asset").drop("__id")


def asset_lookup(events: DataFrame, assets: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """struct `asset`: by explicit id where one is given; else by host name, else by source address (destination if there is no source). Names match in any case. `found` (see asset_cves) is added to the assets first."""
    given = F.nullif("asset_id", F.lit(0)) if "asset_id" in events.columns else F.lit(None).cast("long")
    rows = events.withColumn("__key_id", given)
    rows = rows.withColumn("__host", F.when(F.col("__key_id").isNull(), F.lower(or_null(F.col("hostname")))))
    rows = rows.withColumn("__ip", F.when(F.col("__key_id").isNull(), F.lower(F.coalesce(or_null(F.col("source_ip")), or_null(F.col("destination_ip"))))))
    few = F.broadcast if assets.limit(BROADCAST_ASSETS + 1).count() <= BROADCAST_ASSETS else lambda df: df
    for left, column in (("__host", "hostname"), ("__ip", "ip_address")):
        ids = assets.select(F.lower(column).alias(f"{left}_key"), "id").where(F.col(f"{left}_key").isNotNull()).groupBy(f"{left}_key").agg(F.min("id").alias(f"{left}_id"))
        rows = rows.join(few(ids), F.col(left) == F.col(f"{left}_key"), "left")
    rows = rows.withColumn("__key_id", F.coalesce("__key_id", "__host_id", "__ip_id"))
    whole = assets if found is None else assets.join(found, "id", "left")
    rows = rows.join(few(one_asset(whole, F.col("id"), "id")), F.col("__key_id") == F.col("__id"), "left").withColumnRenamed("__id_asset", "asset")
    return rows.drop("__key_id", "__id", *[f"{left}{end}" for left in ("__host", "__ip") for end in ("", "_key", "_id")])


def ioc_candidates(events: DataFrame) -> DataFrame:
    """(event_id, value): each distinct address, user or host of an event that may be an indicator."""
    values = F.array_distinct(F.concat(F.array("source_ip", "destination_ip", "username", "hostname"), F.coalesce(extract_ips(F.col("raw_log")), F.array().cast("array<string>"))))
    return events.select("event_id", F.explode(F.filter(values, lambda v: v.isNotNull() & (v != ""))).alias("value"))


#: Bits of the set that thins candidates out, 64 to a word: a fixed size, so the broadcast is at most a million words (about 30 MB) however many indicators there are.
BITS = 1 << 26


def too_large_to_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate puts this table beyond the session's threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > limit


def thinned(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """`candidates` (with `value`) without most of those that are no value of `known`: a bit of each value's hash, joined by word, so that the others are not shuffled. None that is one is lost."""
    bit = F.pmod(F.xxhash64("value"), F.lit(BITS))
    words = known.select(F.shiftright(bit, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("b")).groupBy("__word").agg(F.bit_or("b").alias("__bits"))
    held = candidates.withColumn("__word", F.shiftright(bit, 6)).join(F.broadcast(words), "__word")
    return held.where(F.getbit("__bits", F.pmod(bit, F.lit(64)).cast("int")) == 1).drop("__word", "__bits")


def candidate_hits(events: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates of events joined with `known` by value. A table of indicators that is too large to be broadcast thins the candidates out before they are shuffled."""
    candidates = ioc_candidates(events)
    return (thinned(candidates, known.select("value")) if too_large_to_broadcast(known) else candidates).join(known, "value")


def hits_of(events: DataFrame, iocs: DataFrame) -> DataFrame:
    """(event_id, ioc_hits): the matching indicators, sorted by id, of the events that have some."""
    known = iocs.select(F.col("ioc_value").alias("value"), F.struct("id", F.col("ioc_value").alias("value"), F.col("ioc_type").alias("type"), "threat_level", "confidence").alias("ioc"))
    known = known.where("value is not null").groupBy("value").agg(F.collect_set("ioc").alias("iocs"))  # indicators of a value move together
    return candidate_hits(events, known).groupBy("event_id").agg(F.array_sort(F.flatten(F.collect_set("iocs"))).alias("ioc_hits"))


def with_hits(events: DataFrame, hits: DataFrame, keep_all: bool = True) -> DataFrame:
    """Events with their `ioc_hits`, empty where there are none."""
    joint = events.join(hits, "event_id", "left" if keep_all else "inner")
    return joint.withColumn("ioc_hits", F.coalesce("ioc_hits", F.array().cast(joint.schema["ioc_hits"].dataType)))


def ioc_hits(events: DataFrame, iocs: DataFrame, keep_all: bool = True) -> DataFrame:
    """Events with `ioc_hits`, their matching indicators sorted by id: only hits are gathered, and joined back."""
    return with_hits(events, hits_of(events, iocs), keep_all)


def ioc_values(events: DataFrame, iocs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Events with `ioc_hits` as the sorted values of theirs that are an indicator's: for those who ask whether there is a hit. However many indicators share a value, none is carried.

    `stored` holds these events (or more) before they were joined with anything, where there is such a table: values are then taken from it.
    """
    known = iocs.select(F.col("ioc_value").alias("value")).where("value is not null").distinct()
    hits = candidate_hits(events if stored is None else stored, known).groupBy("event_id").agg(F.array_sort(F.collect_set("value")).alias("ioc_hits"))
    return events.join(hits, "event_id", "left").withColumn("ioc_hits", F.coalesce("ioc_hits", F.array().cast("array<string>")))


def ioc_semi(events: DataFrame, iocs: DataFrame, has: bool = True) -> DataFrame:
    """Events with (or, has=False, without) an indicator."""
    hit = candidate_hits(events, iocs.select(F.col("ioc_value").alias("value")).distinct()).select("event_id").distinct()
    return events.join(hit, "event_id", "left_semi" if has else "left_anti")


def newest(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """The k newest CVEs of each key (undated last, then by id), with their rank."""
    order = Window.partitionBy(*key).orderBy(F.col("published_date").desc_nulls_last(), F.col("cve_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct substrings of these sizes; shorter texts give none of them."""
    n = F.char_length(text)
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: text.substr(i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(cut, sizes)))


def product_pairs(haystacks: DataFrame, products: DataFrame) -> DataFrame:
    """(haystack, product): each distinct `haystack` with the distinct products that are substrings of it.

    A product of three characters or more can only occur where each of its trigrams does, so the one that is rarest
    among the products is joined by equality and the rest is verified; shorter products meet every gram of their
    size likewise, and an empty product matches everything.
    """
    texts = haystacks.select("haystack").distinct()
    known = products.select("product").where("product is not null").distinct()
    own = known.where(F.char_length("product") >= 3).select("product", F.explode(grams(F.col("product"), (3,))).alias("gram"))
    often = own.groupBy("gram").agg(F.count("*").alias("often"))
    rarest = own.join(often, "gram").groupBy("product").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"))
    keyed = rarest.select("gram", "product").unionByName(known.where(F.char_length("product") < 3).select(F.col("product").alias("gram"), "product"))
    marked = texts.select("haystack", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), grams(F.col("haystack"), (1, 2, 3))))).alias("gram"))
    return marked.join(keyed, "gram").where(F.col("haystack").contains(F.col("product"))).select("haystack", "product")


def matching_cves(haystacks: DataFrame, cves: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """(haystack, cve_id, published_date, columns, rank): the k newest CVEs of which some product is a substring of the haystack.

    One of a haystack's k newest is also one of the k newest of the product that it matches by, so products keep k
    CVEs before they meet haystacks: pairs grow with the products of a haystack, not with the CVEs of a product.
    """
    stated = cves.select("cve_id", "published_date", *columns, F.explode(F.array_distinct(F.transform("affected_products", lambda p: F.lower(p)))).alias("product")).where("product is not null")
    best = newest(stated, ["product"], k).drop("rank")
    found = product_pairs(haystacks, best).join(best, "product").drop("product").dropDuplicates(["haystack", "cve_id"])
    return newest(found, ["haystack"], k)


def cve_candidates(assets: DataFrame, cves: DataFrame, k: int = 5) -> DataFrame:
    """(id, cve_id, severity, title, rank): each asset's k newest CVEs by its services' JSON text; once a distinct text, not an event."""
    texts = assets.where(F.size("services") > 0).select("id", F.lower(F.to_json("services")).alias("haystack"))
    return texts.join(matching_cves(texts, cves, k, ["severity", "title"]), "haystack").select("id", "cve_id", "severity", "title", "rank")


def asset_cves(assets: DataFrame, cves: DataFrame) -> DataFrame:
    """(id, CVES): the candidate CVEs of the assets that have some, by rank."""
    found = cve_candidates(assets, cves).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "cve_id", "severity", "title"))).alias("c"))
    return found.select("id", F.transform("c", lambda c: F.struct(c["cve_id"].alias("cve_id"), c["severity"].alias("severity"), c["title"].alias("title"))).alias(CVES))


def enrich_events(events: DataFrame, assets: DataFrame, iocs: DataFrame, cves: DataFrame, found: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Events with `asset`, `ioc_hits` and the nested `enrichment` record.

    CVEs come with the asset that they are found for, so events don't move for them. `found` and `hits` are what
    asset_cves and hits_of give, where they are stored already.
    """
    rows = asset_lookup(events, assets, asset_cves(assets, cves) if found is None else found)
    rows = rows.select("*", F.col(f"asset.{CVES}").alias(CVES)).withColumn("asset", F.col("asset").dropFields(CVES))
    rows = with_hits(rows, hits_of(events, iocs) if hits is None else hits)
    rows = once(rows, __source=geo_band(F.col("source_ip")), __destination=geo_band(F.col("destination_ip")))
    context = F.when(F.col("asset").isNotNull(), F.struct(*[F.col(f"asset.{c}").alias(c) for c in ("id", "asset_id", "hostname", "criticality", "business_owner", "environment") if c in assets.columns]))
    record = F.struct(
        F.struct(geo_lookup(F.col("source_ip"), F.col("__source")).alias("source"), geo_lookup(F.col("destination_ip"), F.col("__destination")).alias("destination")).alias("geo"),
        context.alias("asset_context"), F.col("ioc_hits"),
        F.coalesce(CVES, F.array().cast("array<struct<cve_id:string,severity:string,title:string>>")).alias("cve_candidates"),
        mitre_lookup(F.col("event_type")).alias("mitre"),
    )
    return rows.withColumn("enrichment", record).drop(CVES, "__source", "__destination")
