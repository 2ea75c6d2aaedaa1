"""Detection rules: from documents to column predicates, keyed sliding thresholds, scores and reasons.

Rules are a small dimension that is read to the driver. A few are compiled, so that each event meets all of them inside
one projection, which marks those that fit by bits; many are a table, and an index from a list value or a piece of a keyword to rules leads each event to
the few that it may match. Either way rows grow only where a rule may match, and nothing is shuffled. Thresholds are
tested last: counts are made over narrow rows, and only those that reach some rule's count meet the matches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scoring import mitre_lookup, severity_weight
from ..sources.scratch import shared_dir, written
from .normalize import once

#: Up to so many rules are compiled; more are looked up.
CHUNK = 60
#: Rules that are tested in one step, a bit of one number each: few, so that the code made for a step stays small.
PIECE = 10
#: Rules that one job takes: they are held by the driver, and broadcast where they are many.
MOST_RULES = 50_000
#: Marks of one key and bucket that are counted in one task, where they aren't few for the size of the data; and the cells that their numbers are watched in.
BURST, CELLS = 500_000, 1 << 16
#: IN-list predicates of a rule document and the event column of each.
LISTS = {"eventTypes": "event_type", "categories": "event_category", "protocols": "protocol", "destinationPorts": "destination_port", "sourcePorts": "source_port", "usernames": "username"}


@dataclass
class Rule:
    """A rule with its logic as a dict; only what is not null counts."""

    id: int
    rule_id: str
    rule_name: str
    severity: str | None = None
    logic: dict = field(default_factory=dict)
    attack_technique: str | None = None
    attack_tactic: str | None = None
    threshold_count: int | None = None
    threshold_window_minutes: int | None = None
    confidence_weight: int | None = None

    @property
    def threshold(self) -> tuple[str, int, int]:
        """(column, count, minutes)."""
        own = self.logic.get("threshold") or {}
        first = lambda *v: next((x for x in v if x is not None), None)
        column = "username" if own.get("field", "sourceIp") == "username" else "source_ip"
        return column, int(first(own.get("count"), self.threshold_count, 1)), int(first(own.get("windowMinutes"), self.threshold_window_minutes, 5))


def active_rules(rules: DataFrame) -> DataFrame:
    """Enabled rules, newest updated first."""
    return rules.where("enabled").orderBy(F.col("updated_at").desc(), F.col("id").desc())


def normalize_rule_logic(logic: Column, pattern: Column) -> Column:
    """The rule document's JSON: the given object, even an empty one; else the pattern's comma parts as anyKeywords; else {}."""
    parts = F.filter(F.transform(F.split(pattern, ","), lambda p: F.trim(p)), lambda p: p != "")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(logic)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, logic).when(F.nullif(pattern, F.lit("")).isNull(), F.lit("{}")).otherwise(F.to_json(F.struct(parts.alias("anyKeywords"))))


def load_rules(rules: DataFrame) -> list[Rule]:
    """Active rules in order, their logic read. They are collected, so ValueError if there are more than MOST_RULES."""
    rows = active_rules(rules).withColumn("logic", normalize_rule_logic(F.col("detection_logic"), F.col("pattern"))).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} active rules")
    names = [f for f in Rule.__dataclass_fields__ if f != "logic"]
    return [Rule(**{n: r[n] for n in names}, logic=json.loads(r.logic)) for r in rows]


def usable(spark, rules: list[Rule]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Rules whose regex compiles, and (rule_id, reason) of those put aside."""
    good, bad = [], []
    for rule in rules:
        try:
            if rule.logic.get("rawRegex"):
                spark._jvm.java.util.regex.Pattern.compile(str(rule.logic["rawRegex"]))
            good.append(rule)
        except Exception as error:  # noqa: BLE001 - py4j wraps Java's PatternSyntaxException
            bad.append((rule.rule_id, str(error).splitlines()[0][:200]))
    return good, bad


def rule_membership(logic: dict) -> Column:
    """All IN-lists hold; an empty list is no constraint, a null value with a constraint is no match."""
    tests = [F.coalesce(F.col(c).isin(*[str(v) if not c.endswith("port") else int(v) for v in logic[k]]), F.lit(False)) for k, c in LISTS.items() if logic.get(k)]
    return reduce(Column.__and__, tests, F.lit(True))


def searchable() -> Column:
    """What keywords are sought in."""
    return F.lower(F.concat(F.coalesce("raw_log", F.lit("")), F.lit(" "), F.coalesce("parsed_data", F.lit("{}")), F.lit(" "), F.coalesce("event_type", F.lit("")), F.lit(" "), F.coalesce("event_category", F.lit(""))))


def rule_keywords(logic: dict, text: Column) -> Column:
    out = F.lit(True)
    if logic.get("allKeywords"):
        out = out & reduce(Column.__and__, [text.contains(str(k).lower()) for k in logic["allKeywords"]])
    if logic.get("anyKeywords"):
        out = out & reduce(Column.__or__, [text.contains(str(k).lower()) for k in logic["anyKeywords"]])
    return out


def rule_regex(logic: dict) -> Column:
    """Regex over the raw log, in any case."""
    return F.coalesce(F.col("raw_log"), F.lit("")).rlike(f"(?i){logic['rawRegex']}") if logic.get("rawRegex") else F.lit(True)


def rule_ioc_gate(logic: dict) -> Column:
    return F.size("ioc_hits") > 0 if logic.get("matchIoc") else F.lit(True)


def rule_asset_gate(logic: dict) -> Column:
    held = logic.get("assetCriticalities")
    return F.coalesce(F.col("asset.criticality").isin(*held), F.lit(False)) if held else F.lit(True)


def sliding_counts(events: DataFrame, wanted: dict[str, tuple[str, Column, int]], past: DataFrame | None = None) -> DataFrame:
    """`events` with a column for each name in `wanted` (key column, position, width): events of the same key at positions from `width` before to this one's, peers only up to this event id.

    Events of `past` (the same columns) are counted too, but not returned. 1 for null and empty keys and positions. An
    event id stands for one event: rows that repeat it count once and get the same number.
    """
    events = written(events, "counted")
    wide = counts_by_id(events if past is None else events.unionByName(past), wanted)
    joint = events.join(wide, F.col("event_id") == F.col("__id"), "left")
    return joint.select(*[c for c in events.columns if c not in wanted], *[F.coalesce(F.col(f"__{name}"), F.lit(1)).cast("long").alias(name) for name in wanted])


#: What marks are sorted by within a key's bucket.
PLACE = ["place", "ends", "event_id"]
#: Keys come first, as their first bytes tell most of them apart in a sort.
GROUP = ["key", "bucket", "name"]


def counts_by_id(context: DataFrame, wanted: dict[str, tuple[str, Column, int]]) -> DataFrame:
    """(__id, __<name>, ...): the counts of sliding_counts for each event id that has a key.

    Only (event id, key, position) moves: an event counts up in the bucket of `width` that it lies in and down in the
    next one, `width` after its position. One running sum in order of position gives all counts, so the work is linear
    in the events of a key, and a key spreads over as many tasks as it has buckets. Buckets that hold a burst are
    spread too: see `in_parts`.
    """
    marks = []
    for slot, (key, at, width) in enumerate(wanted.values()):
        place, own = at.cast("long"), F.floor(at / width).cast("long")
        for ends in (0, 1):
            marks.append(F.struct(F.lit(slot).alias("name"), F.col(key).cast("string").alias("key"), (own + ends).alias("bucket"), (place + ends * width).alias("place"), F.lit(ends).alias("ends")))
    rows = context.select("event_id", F.inline(F.array(*marks))).where("key != '' and place is not null")
    cell = F.pmod(F.xxhash64(*GROUP), F.lit(CELLS)).cast("int")
    crowded = crowded_cells(rows.select(cell.alias("cell")))
    counted = in_buckets(rows.where(~cell.isin(crowded)) if crowded else rows)
    if crowded:
        counted = counted.unionByName(in_parts(rows.where(cell.isin(crowded))))
    return counted.groupBy(F.col("event_id").alias("__id")).agg(*[F.max(F.when(F.col("name") == slot, F.col("n"))).alias(f"__{name}") for slot, name in enumerate(wanted)])


def crowded_cells(cells: DataFrame) -> list[int]:
    """The cells of which one holds more than BURST rows, and four times the mean: counted in tasks first, at most CELLS rows a task. A bucket of many rows is in one of them."""
    sizes = cells.groupBy("cell").count()
    found = sizes.agg(F.sum("count").alias("total"), F.collect_list(F.when(F.col("count") > BURST, F.struct("cell", "count"))).alias("large")).first()
    least = max(BURST, 4 * (found.total or 0) // CELLS)
    return [r.cell for r in found.large if r["count"] > least]


def in_buckets(rows: DataFrame) -> DataFrame:
    """(name, event_id, n) of marks: a running sum over each bucket; all sums go by one order."""
    ordered = Window.partitionBy(*GROUP).orderBy(*PLACE)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct(*PLACE)).over(ordered)
    fresh = F.when(before.isNull() | (before != F.struct(*PLACE)), 1).otherwise(0)
    rows = rows.withColumn("fresh", fresh)
    begun = F.sum(F.col("fresh") * F.col("ends")).over(whole)
    running = F.sum(F.col("fresh") * (1 - 2 * F.col("ends"))).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("n", begun + running).where("ends = 0 and fresh = 1").select("name", "event_id", "n")


def in_parts(rows: DataFrame) -> DataFrame:
    """As in_buckets, for buckets of any size: marks are dealt by ranges of their order, so that a burst, even of one moment, is spread by its event ids.

    Two levels of sums: one a part and bucket, of which a running sum over the parts gives where each part begins; and
    the running sum inside a part. The ranges are checkpointed (spark.checkpoint.dir), as both must see the same parts.
    """
    shared_dir(rows.sparkSession)
    parts = [*GROUP, "part"]
    dealt = rows.dropDuplicates([*GROUP, *PLACE]).repartitionByRange(*GROUP, *PLACE).withColumn("part", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy(*parts).agg(F.sum(1 - 2 * F.col("ends")).alias("change"), F.sum("ends").alias("ended"))
    earlier = F.sum("change").over(Window.partitionBy(*GROUP).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begins = sums.select(*parts, (F.coalesce(earlier, F.lit(0)) + F.sum("ended").over(Window.partitionBy(*GROUP))).alias("begins"))
    inside = F.sum(1 - 2 * F.col("ends")).over(Window.partitionBy(*parts).orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("inside", inside).join(begins, parts).where("ends = 0").select("name", "event_id", (F.col("begins") + F.col("inside")).alias("n"))


def micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def threshold_window(events: DataFrame, key: str, minutes: int, name: str) -> DataFrame:
    """Column `name`: events of the same key in the `minutes` before, the bound included, and this one; ties by event id."""
    return sliding_counts(events, {name: (key, micros(), minutes * 60_000_000)})


def with_rank(events: DataFrame, name: str) -> DataFrame:
    """Column `name`: the place of each event in the order of (ts, event_id), from 0: a range sort, and the counts of the partitions before.

    The sorted rows are checkpointed (spark.checkpoint.dir), as both steps must see the same partitions.
    """
    dealt = events.repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__id", 33)
    sizes = {r.p: r["count"] for r in dealt.groupBy(part.alias("p")).count().collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(total)]
        total += sizes[p]
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return dealt.withColumn(name, (start + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("__id")


def capped_threshold(events: DataFrame, key: str, minutes: int, name: str, recent: int = 300) -> DataFrame:
    """As threshold_window, but only among the `recent` events, of any key, that came before: the parity mode of a job that looks at so many.

    Time and place run alike, so what both windows hold is the smaller of the two.
    """
    rows = sliding_counts(with_rank(events, "__rank"), {"__in_time": (key, micros(), minutes * 60_000_000), "__in_reach": (key, F.col("__rank"), recent)})
    return rows.withColumn(name, F.least("__in_time", "__in_reach")).drop("__in_time", "__in_reach", "__rank")


def thresholds_of(rules: list[Rule]) -> list[tuple[str, int]]:
    """The distinct (key, minutes) that rules count over."""
    return sorted({r.threshold[::2] for r in rules if r.threshold[1] > 1})


def reached(events: DataFrame, rules: list[Rule], past: DataFrame | None = None) -> DataFrame:
    """(__id, __<count name>, ...) of the events that reach the least count of some rule: counted over all of `events` and the earlier ones in `past`, in one pass."""
    narrow = [F.col(c) for c in ("event_id", "ts", "source_ip", "username")]
    context = events.select(*narrow) if past is None else events.select(*narrow).unionByName(past.select(*[F.col(c) if c in past.columns else F.lit(None).alias(c) for c in ("event_id", "ts", "source_ip", "username")]))
    wide = counts_by_id(context, {count_name(key, minutes): (key, micros(), minutes * 60_000_000) for key, minutes in thresholds_of(rules)})
    least: dict[str, int] = {}
    for r in rules:
        key, count, minutes = r.threshold
        if count > 1:
            name = count_name(key, minutes)
            least[name] = min(count, least.get(name, count))
    return wide.where(reduce(Column.__or__, [F.col(f"__{name}") >= n for name, n in least.items()]))


def count_name(key: str, minutes: int) -> str:
    return f"count_{key}_{minutes}m"


#: The wordings of reasons are fixed values.
def reasons_of(rule: Rule) -> list[tuple[str, str]]:
    """(what the reason shows of the event, its wording before that) for each reason in order, but for the threshold's."""
    logic, out = rule.logic, []
    if logic.get("rawRegex"):
        out.append(("", f"Matched regex {logic['rawRegex']}"))
    if logic.get("matchIoc"):
        out.append(("", "Matched IOC enrichment hit"))
    if logic.get("assetCriticalities"):
        out.append(("criticality", "Asset criticality "))
    return out


def threshold_reason(rule: Rule) -> tuple[str, str] | None:
    """What stands before and after the count in the threshold's reason."""
    key, count, minutes = rule.threshold
    if count <= 1:
        return None
    shown = "username" if key == "username" else "sourceIp"
    if (rule.logic.get("threshold") or {}).get("field") not in (None, "sourceIp", "username"):
        shown = str(rule.logic["threshold"]["field"])
    return f"Threshold met on {shown}: ", f"/{count} in {minutes}m"


def match_reasons(reasons: Column, asset_reason: Column) -> Column:
    """A rule's own reasons in order, and that of the asset where it has one; the threshold's is added when the count is known."""
    return F.when(asset_reason.isNull(), reasons).otherwise(F.array_append(reasons, F.concat(asset_reason, F.col("asset.criticality"))))


def default_reason(rule: Rule) -> str:
    return f"Matched Sigma-like logic for {rule.rule_name}"


def weight_of(rule: Rule) -> int:
    """The part of the score that the rule alone gives: its weight, and three a reason."""
    return (50 if rule.confidence_weight is None else int(rule.confidence_weight)) + 3 * (len(reasons_of(rule)) + (rule.threshold[1] > 1))


def rule_confidence(weight: Column) -> Column:
    """At most 99: the rule's weight, event severity, indicator hit, asset criticality."""
    asset = F.when(F.col("asset.criticality") == "critical", 12).when(F.col("asset.criticality") == "high", 8).otherwise(0)
    return F.least(F.lit(99), weight + severity_weight(F.col("severity")) + F.when(F.size("ioc_hits") > 0, 15).otherwise(0) + asset).cast("int")


def match_mitre(technique: Column, tactic: Column) -> tuple[Column, Column]:
    """(technique, tactic): the event type's, else the rule's; a technique without tactic is of tactic Detection."""
    known = mitre_lookup(F.col("event_type"))
    own = F.nullif(technique, F.lit(""))
    return F.coalesce(known["technique"], own), F.coalesce(known["tactic"], F.nullif(tactic, F.lit("")), F.when(own.isNotNull(), "Detection"))


MATCH = ["rule_pk", "rule_id", "rule_name", "rule_severity", "confidence", "reasons", "mitre_technique", "mitre_tactic"]
NEEDS = "struct<name:string,count:int,before:string,after:string>"


def needs_of(rule: Rule) -> tuple[str, int, str, str] | None:
    """(count name, count, wording before it, wording after it) of a rule with a threshold."""
    key, count, minutes = rule.threshold
    reason = threshold_reason(rule)
    return (count_name(key, minutes), count, *reason) if reason else None


#: What a match takes from its rule, and the predicates that are tested once an event has its context.
STATED = f"pk: long, rule_id: string, rule_name: string, severity: string, weight: int, reasons: array<string>, asset_reason: string, technique: string, tactic: string, needs: {NEEDS}, ioc: boolean, criticalities: array<string>"


def stated(rule: Rule) -> tuple:
    """The values of STATED."""
    reasons = [text for shows, text in reasons_of(rule) if not shows]
    asset = next((text for shows, text in reasons_of(rule) if shows), None)
    if not reasons and asset is None and not needs_of(rule):
        reasons = [default_reason(rule)]
    return (rule.id, rule.rule_id, rule.rule_name, rule.severity, weight_of(rule), reasons, asset, rule.attack_technique, rule.attack_tactic, needs_of(rule), bool(rule.logic.get("matchIoc")), [str(v) for v in rule.logic.get("assetCriticalities") or ()])


def literal(value) -> Column:
    """A list, tuple (as a struct) or plain value as a column."""
    if isinstance(value, list):
        return F.array(*map(literal, value))
    return F.struct(*map(literal, value)) if isinstance(value, tuple) else F.lit(value)


def own_tests(rule: Rule, text: Column) -> Column:
    """Whether an event fits by what it says itself: all but indicators, assets and thresholds."""
    return rule_membership(rule.logic) & rule_keywords(rule.logic, text) & rule_regex(rule.logic)


def marked(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """The events that fit some rule by what they say themselves, with a bit for each such rule in `__hits_<k>`, PIECE rules a column.

    Only this step needs an event's texts, so where it comes before the joins, they aren't moved.
    """
    rows = once(events, __text=searchable())
    pieces = [rules[i : i + PIECE] for i in range(0, len(rules), PIECE)]
    for k, piece in enumerate(pieces):
        bits = [F.when(own_tests(r, F.col("__text")), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(piece)]
        rows = once(rows, **{f"__hits_{k}": reduce(Column.__add__, bits)})
    return rows.where(reduce(Column.__or__, [F.col(f"__hits_{k}") != 0 for k in range(len(pieces))])).drop("__text")


def is_marked(events: DataFrame) -> bool:
    return "__hits_0" in events.columns


def match_of() -> Column:
    """struct of the match of a row with its rule's STATED in `__rule`; a threshold is what it still `needs`."""
    r = lambda name: F.col(f"__rule.{name}")
    technique, tactic = match_mitre(r("technique"), r("tactic"))
    values = [r("pk"), r("rule_id"), r("rule_name"), r("severity"), rule_confidence(r("weight")), match_reasons(r("reasons"), r("asset_reason")), technique, tactic]
    return F.struct(*[v.alias(n) for v, n in zip(values, MATCH, strict=True)], r("needs").alias("needs"))


def in_context() -> Column:
    """Whether the context of a row fits its rule in `__rule`: the gates of indicators and assets."""
    held = F.col("__rule.criticalities")
    return (~F.col("__rule.ioc") | (F.size("ioc_hits") > 0)) & ((F.size(held) == 0) | F.coalesce(F.array_contains(held, F.col("asset.criticality")), F.lit(False)))


def by_projection(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """`rows`, marked already or not, exploded by `match`: all rules in one projection.

    The bits of a row are exploded to what their rules state, which are literals, so that a match is made in one place
    for all rules and only where a rule fits.
    """
    rows = rows if is_marked(rows) else marked(rows, rules)
    bit = lambda k: F.col(f"__hits_{k // PIECE}").bitwiseAND(F.lit(1 << k % PIECE)) != 0
    found = F.array(*[F.when(bit(k), literal(stated(r)).cast(f"struct<{STATED}>")) for k, r in enumerate(rules)])
    rows = rows.withColumn("__rule", F.explode(found)).where(F.col("__rule").isNotNull() & in_context())
    return rows.withColumn("match", match_of()).drop("__rule", *[f"__hits_{k}" for k in range(0, 1 + (len(rules) - 1) // PIECE)])


#: Parts of keywords that the index holds.
GRAM = 3


def anchors_of(rule: Rule, shared: dict[str, int]) -> list[str]:
    """Keys of which an event that matches the rule has at least one: of the predicates that give such keys the one that tells most.

    `shared` has the number of rules that each gram occurs in; a keyword's key is the gram that the fewest share. A rule
    without such a predicate has the key that all events have.
    """
    logic = rule.logic
    rarest = lambda k: min((k[i : i + GRAM] for i in range(len(k) - GRAM + 1)), key=lambda g: (shared[g], g))
    words = lambda name: [str(k).lower() for k in logic.get(name) or ()]
    every = [k for k in words("allKeywords") if len(k) >= GRAM]
    if every:
        return [f"k:{min((rarest(k) for k in every), key=lambda g: (shared[g], g))}"]
    for name in ("usernames", "destinationPorts", "sourcePorts"):
        if logic.get(name):
            return sorted({f"{name}:{v}" for v in logic[name]})
    some = words("anyKeywords")
    if some and all(len(k) >= GRAM for k in some):
        return sorted({f"k:{rarest(k)}" for k in some})
    if logic.get("matchIoc"):
        return ["ioc"]
    if logic.get("assetCriticalities"):
        return sorted({f"asset:{v}" for v in logic["assetCriticalities"]})
    for name in ("eventTypes", "protocols", "categories"):
        if logic.get(name):
            return sorted({f"{name}:{v}" for v in logic[name]})
    return ["any"]


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """(__at: a key, __rule: struct of the rule's predicates and wordings): a row for each rule and key."""
    shared: dict[str, int] = {}
    for r in rules:
        for g in {str(k).lower()[i : i + GRAM] for name in ("allKeywords", "anyKeywords") for k in r.logic.get(name) or () for i in range(max(0, len(str(k)) - GRAM + 1))}:
            shared[g] = shared.get(g, 0) + 1
    out = []
    for r in rules:
        own = anchors_of(r, shared)
        lists = [[str(v) if not c.endswith("port") else int(v) for v in r.logic.get(k) or ()] for k, c in LISTS.items()]
        keywords = [[str(k).lower() for k in r.logic.get(name) or ()] for name in ("allKeywords", "anyKeywords")]
        regex = f"(?i){r.logic['rawRegex']}" if r.logic.get("rawRegex") else None
        row = (own, *lists, *keywords, regex, *stated(r))
        out += [(a, row) for a in own]
    lists = ", ".join(f"{k}: array<{'int' if c.endswith('port') else 'string'}>" for k, c in LISTS.items())
    fields = f"anchors: array<string>, {lists}, all_words: array<string>, any_words: array<string>, regex: string, {STATED}"
    return spark.createDataFrame(out, f"__at string, __rule struct<{fields}>")


def by_index(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """`rows` (with __text) exploded by `match`: an event meets the rules that its keys lead to, and each rule by the first of its keys only.

    The table of rules is broadcast (MOST_RULES at most), so no event moves.
    """
    table = rule_table(rows.sparkSession, rules)
    held = sorted({r["__at"] for r in table.select("__at").distinct().collect()})
    grams = [a[2:] for a in held if a.startswith("k:")]
    keyed = lambda name, value: F.concat(F.lit(f"{name}:"), value.cast("string"))
    keys = [F.array(F.lit("any"), F.when(F.size("ioc_hits") > 0, "ioc"), keyed("asset", F.col("asset.criticality")), *[keyed(k, F.col(c)) for k, c in LISTS.items()])]
    if grams:
        cut = F.regexp_extract_all("__text", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), 1)
        keys.append(F.transform(F.array_distinct(F.filter(cut, lambda g: g.isin(grams))), lambda g: F.concat(F.lit("k:"), g)))
    rows = rows.withColumn("__keys", F.filter(F.concat(*keys), lambda k: k.isin(held)))
    rows = rows.withColumn("__anchor", F.explode("__keys")).join(F.broadcast(table), F.col("__anchor") == F.col("__at"))
    r = lambda name: F.col(f"__rule.{name}")
    tests = [F.get(F.filter(r("anchors"), lambda a: F.array_contains(F.col("__keys"), a)), F.lit(0)) == F.col("__anchor")]
    tests += [(F.size(r(k)) == 0) | F.coalesce(F.array_contains(r(k), F.col(c)), F.lit(False)) for k, c in LISTS.items()]
    tests += [F.forall(r("all_words"), lambda k: F.col("__text").contains(k)), (F.size(r("any_words")) == 0) | F.exists(r("any_words"), lambda k: F.col("__text").contains(k))]
    tests += [r("regex").isNull() | F.rlike(F.coalesce("raw_log", F.lit("")), r("regex")), in_context()]
    found = rows.where(reduce(Column.__and__, tests))
    return found.withColumn("match", match_of()).drop("__keys", "__anchor", "__at", "__rule")


def evaluate_rules(events: DataFrame, rules: list[Rule], past: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """One row for each event and rule that match: the event's columns and `match`. Events carry `asset` and `ioc_hits`.

    Thresholds are counted over all of them, and over `past` (earlier events, of which only id, time and keys are
    read). `counted` is the same events before they were joined with anything, where there is such a table: the counts
    are then made without those joins. Events may be `marked` with these rules already. ValueError if there are more than MOST_RULES rules.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names = [count_name(*t) for t in thresholds_of(rules)]
    rows = events
    if names:  # before the rules: events move once, by the id that their other joins go by
        counts = reached(events if counted is None else counted, rules, past)
        rows = rows.join(counts, F.col("event_id") == F.col("__id"), "left").drop("__id")
    if len(rules) <= CHUNK:
        found = by_projection(rows, rules or [Rule(0, "", "")])
    else:
        found = by_index(rows.withColumn("__text", searchable()), rules).drop("__text")
    final = lambda *reasons: F.struct(*[F.col(f"match.{n}") if n != "reasons" else (reasons[0] if reasons else F.col("match.reasons")).alias(n) for n in MATCH])
    if not rules:
        return found.where("false").withColumn("match", final())
    if not names:
        return found.withColumn("match", final())
    n = F.coalesce(*[F.when(F.col("match.needs.name") == name, F.col(f"__{name}")) for name in names])
    met = found.where(F.col("match.needs").isNull() | (n >= F.col("match.needs.count")))
    reasons = F.when(F.col("match.needs").isNull(), F.col("match.reasons")).otherwise(F.array_append("match.reasons", F.concat("match.needs.before", n.cast("string"), "match.needs.after")))
    return met.withColumn("match", final(reasons)).drop(*[f"__{name}" for name in names])
