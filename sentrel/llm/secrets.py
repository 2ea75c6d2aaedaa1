"""Secret scans: base patterns, plus probabilistic automata inferred from the credentials that those patterns label.

1. One pass over all texts keeps, in each task, the values of each kind and the ordinary tokens with the smallest
   hashes, as strings of character classes: no credential is written anywhere or sent to the driver.
2. The bounded samples that follow build prefix trees; states whose outgoing frequencies agree within a Hoeffding
   bound are merged (red-blue order), which gives one probabilistic automaton a kind and one of ordinary tokens.
3. A second pass finds the base spans again and scores every other token: the best kind's log-likelihood, of its
   automaton and of the value's length, less that of ordinary tokens. Those over `margin` become spans of kind `format`. Automata read classes, so a task scores
   each string of classes once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import as_bytes, col_of, give_back, in_small_batches, map_texts, slices

#: Fixed by the contract of the base kinds, in their listed order.
KINDS = ("assign", "access", "hex")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Every run of credential characters that is long enough to be one; access keys and hex runs lie inside.
LEAST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
CANDIDATE_BYTES = re.compile(CANDIDATE.pattern.encode())


def symbol(c: str) -> str:
    """The automata read classes of characters; punctuation stands for itself."""
    if c.isdigit():
        return "9"
    if c.islower():
        return "h" if c <= "f" else "l"
    if c.isupper():
        return "H" if c <= "F" else "U"
    return c


#: ASCII by class, as a table for bytes: what is no candidate character stays outside.
CLASSES = bytes(ord(symbol(chr(b))) if b < 128 else b for b in range(256))
#: A hex run of the base kind, in classes.
LONG_HEX = re.compile(b"[9h]{24}")
SYMBOLS = 12  # classes that a candidate can hold, and the end
LENGTHS = 28  # steps of length up to some hundred characters

SPANS = "array<struct<kind:string,start:long,end:long,value:string>>"


def base_spans(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[str, int, int, str]]]:
    """Base spans by (start, kind as listed), and the candidates that touch none of them."""
    spans = [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    tokens = [(m.start(), m.group()) for m in CANDIDATE.finditer(text)]
    for at, token in tokens:
        if "AKIA" in token:
            spans += [("access", at + m.start(), at + m.end(), m.group()) for m in ACCESS.finditer(token) if len(m.group()) >= 20]
        if len(token) >= 24:
            spans += [("hex", at + m.start(), at + m.end(), m.group()) for m in HEX.finditer(token) if len(m.group()) >= 24]
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    rest, i, furthest = [], 0, -1
    for at, token in tokens:  # both lists run by start
        while i < len(spans) and spans[i][1] < at + len(token):
            furthest = max(furthest, spans[i][2])
            i += 1
        if furthest <= at:
            rest.append(("format", at, at + len(token), token))
    return spans, rest


def may_hold_base(text: bytes, classes: bytes) -> bool:
    low = text.lower()
    return b"AKIA" in text or any(k in low for k in KEYWORDS) or LONG_HEX.search(classes) is not None


def classes_of(value: str) -> bytes:
    return value.encode("utf-8", "surrogatepass").translate(CLASSES)


class Automaton:
    """A probabilistic automaton: per state how often it was left by each class, how often a value ended there."""

    def __init__(self, steps: list[dict[int, tuple[int, int]]], ends: list[int]):
        self.logs: list[dict[int, tuple[float, int]]] = []
        self.ends: list[float] = []
        self.rare: list[float] = []
        for out, end in zip(steps, ends, strict=True):
            total = end + sum(n for _, n in out.values()) + 0.1 * SYMBOLS
            self.logs.append({c: (math.log((n + 0.1) / total), to) for c, (to, n) in out.items()})
            self.ends.append(math.log((end + 0.1) / total))
            self.rare.append(math.log(0.1 / total))

    def likelihood(self, classes: bytes) -> float:
        """Log-likelihood of a whole value, given as classes. A class that the state has never seen costs its smoothed share and keeps the state."""
        at, total = 0, 0.0
        for c in classes:
            log, at = self.logs[at].get(c, (self.rare[at], at))
            total += log
        return total + self.ends[at]


def infer(values: list[bytes], alpha: float = 0.05) -> Automaton:
    """Merge statistically compatible states of the values' prefix tree, nearest to the root first; values are strings of classes."""
    steps: list[dict[int, int]] = [{}]
    passed: list[int] = [0]
    ended: list[int] = [0]
    for value in values:
        at = 0
        passed[0] += 1
        for c in value:
            if c not in steps[at]:
                steps[at][c] = len(steps)
                steps.append({})
                passed.append(0)
                ended.append(0)
            at = steps[at][c]
            passed[at] += 1
        ended[at] += 1
    counts: list[dict[int, int]] = [{c: passed[to] for c, to in out.items()} for out in steps]
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(n1: int, m1: int, n2: int, m2: int) -> bool:
        return abs(n1 / m1 - n2 / m2) > factor * (1 / math.sqrt(m1) + 1 / math.sqrt(m2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            m1, m2 = passed[a], passed[b]
            if not m1 or not m2:
                continue
            if differ(ended[a], m1, ended[b], m2):
                return False
            for c in counts[a].keys() | counts[b].keys():
                if differ(counts[a].get(c, 0), m1, counts[b].get(c, 0), m2):
                    return False
            todo += [(steps[a][c], steps[b][c]) for c in steps[b].keys() & steps[a].keys()]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            passed[a] += passed[b]
            ended[a] += ended[b]
            for c, to in steps[b].items():
                counts[a][c] = counts[a].get(c, 0) + counts[b][c]
                if c in steps[a]:
                    todo.append((steps[a][c], to))
                else:
                    steps[a][c] = to

    red: list[int] = [0]
    blue: deque[tuple[int, int]] = deque((0, c) for c in sorted(steps[0]))
    reds = {0}
    while blue:
        parent, c = blue.popleft()
        node = steps[parent][c]
        if node in reds:
            continue
        into = next((r for r in red if compatible(r, node)), None)
        if into is None:
            red.append(node)
            reds.add(node)
            blue.extend((node, k) for k in sorted(steps[node]))
            continue
        steps[parent][c] = into
        fold(into, node)
        blue.extend((r, k) for r in red for k in sorted(steps[r]) if steps[r][k] not in reds)
        blue = deque(dict.fromkeys(blue))
    number = {r: i for i, r in enumerate(red)}
    return Automaton([{c: (number[steps[r][c]], counts[r][c]) for c in steps[r]} for r in red], [ended[r] for r in red])


def samples(docs: DataFrame, text_col: str, sizes: dict[str, int], max_chars: int) -> dict[str, list[bytes]]:
    """For each kind, and 'ordinary' (tokens outside the base spans), the classes of the distinct values with the smallest hashes: at most its size in `sizes`, none over `max_chars`."""

    def start():
        least: dict[str, dict[int, bytes]] = {k: {} for k in sizes}
        limit = dict.fromkeys(sizes, 1 << 64)

        def take(kind: str, value: bytes) -> None:
            h = xxhash.xxh3_64_intdigest(value)
            if h < limit[kind] and len(value) <= max_chars:
                own = least[kind]
                own[h] = value.translate(CLASSES)
                if len(own) >= 2 * sizes[kind] + 1000:
                    for x in sorted(own)[sizes[kind] :]:
                        del own[x]
                    limit[kind] = max(own)

        def of(texts: list[bytes | None]) -> None:
            for t in texts:
                if not t:
                    continue
                if not may_hold_base(t, t.translate(CLASSES)):
                    for token in set(CANDIDATE_BYTES.findall(t)):
                        take("ordinary", token)
                    continue
                base, rest = base_spans(t.decode("utf-8", "replace"))
                for kind, _, _, value in base:
                    take(kind, value.encode())
                for _, _, _, value in rest:
                    take("ordinary", value.encode())

        return least, of

    schema = pa.schema([("kind", pa.string()), ("h", pa.binary()), ("classes", pa.binary())])

    def run(batches):
        least, of = start()
        for batch in batches:
            for part in slices(batch, "text"):
                of(part.column(0).to_pylist())
        rows = [(k, h.to_bytes(8, "big"), c) for k, own in least.items() for h, c in sorted(own.items())[: sizes[k]]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema)
        give_back()

    found = in_small_batches(docs.select(as_bytes(text_col).alias("text"))).mapInArrow(run, "kind string, h binary, classes binary").distinct()
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("h", "classes"))
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("kind"))
    out: dict[str, list[bytes]] = {k: [] for k in sizes}
    for r in found.withColumn("rank", rank).where((F.col("rank") <= max(sizes.values())) & (F.col("rank") <= wanted)).orderBy("kind", "rank").collect():
        out[r.kind].append(bytes(r.classes))
    return out


class Lengths:
    """Log-probabilities of a value's length, by quarters of an octave: the loops that merging makes in an automaton forget it."""

    def __init__(self, values: list[bytes]):
        held = Counter(self.step(len(v)) for v in values)
        self.known = {step: math.log((n + 0.5) / (len(values) + 0.5 * LENGTHS)) for step, n in held.items()}
        self.rare = math.log(0.5 / (len(values) + 0.5 * LENGTHS))

    @staticmethod
    def step(n: int) -> int:
        return int(4 * math.log2(n))

    def likelihood(self, n: int) -> float:
        return self.known.get(self.step(n), self.rare)


class Judge:
    """Whether a string of classes reads like a credential: the likelihood of its best format, by automaton and length, less the ordinary one's passes the margin."""

    def __init__(self, formats: dict[str, tuple[Automaton, Lengths]], ordinary: tuple[Automaton, Lengths], margin: float):
        self.formats, self.ordinary, self.margin = formats, ordinary, margin
        self.known: dict[bytes, bool] = {}

    def score(self, classes: bytes) -> float:
        of = lambda f: f[0].likelihood(classes) + f[1].likelihood(len(classes))
        return max(map(of, self.formats.values())) - of(self.ordinary)

    def __call__(self, classes: bytes) -> bool:
        found = self.known.get(classes)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[classes] = self.score(classes) > self.margin
        return found


def learn(docs: DataFrame, text_col: str, max_labels: int, max_ordinary: int, max_label_chars: int, margin: float) -> Judge | None:
    values = samples(docs, text_col, dict.fromkeys(KINDS, max_labels) | {"ordinary": max_ordinary}, max_label_chars)
    formats = {k: (infer(values[k]), Lengths(values[k])) for k in KINDS if values[k]}
    return Judge(formats, (infer(values["ordinary"]), Lengths(values["ordinary"])), margin) if values["ordinary"] and formats else None


def spans_of(raw: bytes | None, judge: Judge | None) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text, and its spans by start and then kind as listed, `format` last."""
    if not raw:
        return "", []
    classes = raw.translate(CLASSES)
    odd = judge is not None and any(map(judge, set(CANDIDATE_BYTES.findall(classes))))
    if not odd and not may_hold_base(raw, classes):
        return "", []
    text = raw.decode("utf-8", "replace")
    base, rest = base_spans(text)
    if odd:
        base = sorted(base + [s for s in rest if judge(classes_of(s[3]))], key=lambda s: s[1])  # stable, and a format span touches no other
    return text, base


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 300, max_ordinary: int = 5000, max_label_chars: int = 96, margin: float = 12.0) -> DataFrame:
    """(doc_id, spans: kind, start, end, value) for each row, by start and then kind; code points, end exclusive.

    Null and empty texts have no spans. Repeated rows each get their result; a null id stays null; other columns of
    `docs` are not read. Every token of 6 characters or more that touches no base span is a candidate and is scored,
    letters or digits alone too; no shorter token is one, as in the base kinds. Values over `max_label_chars`
    characters do not train, but are scanned and scored whole. The automata are learned from at most `max_labels`
    distinct labelled values a kind and `max_ordinary` ordinary tokens, those of the smallest hashes; a kind without
    labels has no automaton, and without any label or any ordinary token the base spans are the whole result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col, max_labels, max_ordinary, max_label_chars, margin))

    def start():
        judge = shared.value

        def of(batch: pa.RecordBatch) -> dict:
            found = [spans_of(t, judge)[1] for t in col_of(batch, "text").to_pylist()]
            return {"doc_id": col_of(batch, "doc_id"), "spans": [[dict(zip(("kind", "start", "end", "value"), s, strict=True)) for s in own] for own in found]}

        return of

    return map_texts(docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("text")), "text", f"doc_id {kind}, spans {SPANS}", start)


def joined(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end of the spans, comma-joined."""
    spans = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(value: str | None, judge: Judge | None) -> str | None:
    """The text with its spans replaced by their kind in brackets; overlapping ones by the first one's."""
    text, spans = spans_of((value or "").encode("utf-8", "surrogatepass"), judge)
    if not spans:
        return value
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out.append(f"{text[at:start]}[{kind}]")
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 300, max_ordinary: int = 5000, max_label_chars: int = 96, margin: float = 12.0) -> DataFrame:
    """`docs` with every found span masked; rows and columns stay, nulls too, and each row is judged by its own text.

    Empty texts stay empty, an empty table stays one, very long texts are masked whole, repeated rows alike.
    The automata are learned as in scan_secrets; the rows are rewritten where they lie, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, text_col, max_labels, max_ordinary, max_label_chars, margin))

    def run(batches):
        judge = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                k = batch.schema.get_field_index(text_col)
                texts = [masked(t, judge) for t in batch.column(k).to_pylist()]
                yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
        give_back()

    return in_small_batches(docs).mapInArrow(run, docs.schema)
