"""Chat formatting as prefix trees: conversations that share initial turns share their tokens.

Tokens are code points of the formatted text. Each conversation's turns get chained prefix hashes, so a hash names
a node of the tree. Distinct conversations are range-sorted by their arrays of prefix hashes; in that order a
conversation's new nodes are those beyond what it shares with the one before, which is depth-first order. A pack
holds consecutive conversations of one tree up to `pack_chars` (and at least one); each of its nodes is emitted
once, with position ids along its own path and the intervals of the pack that its ancestors occupy. Only what a
conversation adds counts towards the pack, so a shared root is emitted once a pack; a tree that fills several packs,
or lies across range partitions, repeats in each the one path that it is cut at. Copies of a conversation are one
path, and every conversation is listed with the path that it takes.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import in_small_batches, written

#: Fixed control strings of the template.
OPEN, CLOSE, MARK = "<|im_start|>", "<|im_end|>\n", "<|"
LEARNED = "assistant"


def escaped(text: str, line: bool = False) -> str:
    """No control string is left in it; with `line`, no line end either."""
    text = text.replace("\\", "\\\\").replace(MARK, "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where in it the loss mask lies (empty unless the assistant speaks)."""
    head = f"{OPEN}{escaped(role, True)}\n"
    body = escaped(text)
    segment = head + body + CLOSE
    return (segment, len(head), len(head) + len(body)) if role == LEARNED else (segment, 0, 0)


def parsed(segment: str) -> tuple[str, str]:
    """(role, text) of a segment."""
    role, _, body = segment[len(OPEN) :].partition("\n")
    return unescaped(role), unescaped(body[: -len(CLOSE)])


def stream(df: DataFrame, schema: str, row, start) -> DataFrame:
    """mapInArrow that keeps one state over a partition's sorted rows, a few megabytes of them at a time; `row(state, values)` returns the output rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        state = start()
        for batch in batches:
            out = []
            for values in batch.to_pylist():
                out += row(state, values)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, wanted)
                    out = []
            yield pa.RecordBatch.from_pylist(out, wanted)

    return in_small_batches(df).mapInArrow(run, schema)


def chained(state: dict, r: dict) -> list[dict]:
    if state.get("conv", state) != r["conv_id"]:
        state.update(conv=r["conv_id"], hash=b"", seq=-1)
    role, text = r["role"] or "", r["text"] or ""
    segment, a, b = formatted(role, text)
    state["hash"] = hashlib.sha256(state["hash"] + segment.encode("utf-8", "surrogatepass")).digest()[:16]
    state["seq"] += 1
    return [{"conv_id": r["conv_id"], "seq": state["seq"], "node": state["hash"], "role": role, "segment": segment, "mask_start": a, "mask_end": b, "n": len(segment)}]


def shared(state: dict, r: dict, pack_chars: int) -> list[dict]:
    """How many turns a path shares with the one before it in its pack; a new pack when the root differs or the pack is full."""
    path, before = r["path"], state.get("path", [])
    common = next((i for i, (x, y) in enumerate(zip(path, before, strict=False)) if x != y), min(len(path), len(before)))
    if not common or state["chars"] + sum(r["sizes"][common:]) > pack_chars:
        state["pack"], state["chars"], common = r["ord"], 0, 0
    state["path"] = path
    state["chars"] += sum(r["sizes"][common:])
    return [{"conv_id": r["conv_id"], "pack": state["pack"], "ord": r["ord"], "shared": common, "turns": len(path)}]


def placed(state: dict, r: dict) -> list[dict]:
    """A node's place in its pack: start, position id of its first token, ancestors' intervals."""
    if state.get("pack", state) != r["pack"]:
        state.update(pack=r["pack"], at=0, stack=[])
    stack = state["stack"]
    del stack[r["seq"] :]
    above = stack[-1] if stack else {"position": 0, "intervals": []}
    start, end = state["at"], state["at"] + r["n"]
    held = above["intervals"]
    own = [*held[:-1], (held[-1][0], end)] if held and held[-1][1] == start else [*held, (start, end)]
    stack.append({"position": above["position"] + r["n"], "intervals": own})
    state["at"] = end
    mask = [{"start": start + r["mask_start"], "end": start + r["mask_end"]}] if r["mask_end"] else []
    return [
        {
            "pack": r["pack"],
            "start": start,
            "end": end,
            "depth": r["seq"],
            "position": above["position"],
            "attends": [{"start": a, "end": b} for a, b in held],
            "loss": mask,
            "segment": r["segment"],
            "path_id": r["conv_id"] if r["seq"] == r["turns"] - 1 else None,
        }
    ]


def format_trees(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pack_chars: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, members).

    nodes: pack, start, end, depth, position (id of the first token; the others follow), attends (intervals of the
    pack that the ancestors occupy; within the node attention is causal), loss (intervals under the mask: assistant
    texts), segment, path_id (the conversation that ends here, or null). members: conv_id, path_id.
    path_id is the key of a conversation: its id as text after "=", or empty for null.
    Turns run by number (nulls first), then role and text; repeated rows are turns of their own. Null texts and
    roles are empty. Rows of a null conversation id are one more conversation. Very long texts are one node, however
    long. An empty table gives no nodes and no members. Other columns, whatever their names, are not read.
    """
    kind = "string"
    key = F.concat(F.lit("="), F.col(f"`{conv_col}`").cast("string"))
    rows = conversations.select(F.coalesce(key, F.lit("")).alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = written(stream(dealt, f"conv_id {kind}, seq int, node binary, role string, segment string, mask_start int, mask_end int, n int", chained, dict), "turns")
    paths = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node", "n"))).alias("p")).select("conv_id", F.transform("p", lambda x: x["node"]).alias("path"), F.transform("p", lambda x: x["n"]).alias("sizes"))
    paths = written(paths.withColumn("leaf", F.element_at("path", -1)), "paths")
    reps = paths.groupBy("leaf").agg(F.min("conv_id").alias("path_id"))
    real = F.when(F.col("conv_id") != "", F.substring("conv_id", 2, 2**31 - 1)).cast(conversations.schema[conv_col].dataType).alias("conv_id")
    members = written(paths.select("conv_id", "leaf").join(reps, "leaf").select(real, "path_id"), "members")
    some = paths.join(reps.select(F.col("path_id").alias("conv_id")), "conv_id", "left_semi").select("conv_id", "path", "sizes")
    ranked = written(some.repartitionByRange(F.col("path")).sortWithinPartitions("path"), "ranked")
    ranked = ranked.select("*", F.monotonically_increasing_id().alias("ord"))

    def split(state: dict, r: dict) -> list[dict]:
        return shared(state, r, pack_chars)

    order = written(stream(ranked, f"conv_id {kind}, pack long, ord long, shared int, turns int", split, lambda: {"chars": 0, "pack": None}), "order")
    fresh = turns.join(order, "conv_id").where("seq >= shared")
    packed = fresh.select("pack", "ord", "seq", "turns", "conv_id", "segment", "mask_start", "mask_end", "n").repartition("pack").sortWithinPartitions("pack", "ord", "seq")
    span = "array<struct<start:long,end:long>>"
    nodes = stream(packed, f"pack long, start long, end long, depth int, position long, attends {span}, loss {span}, segment string, path_id {kind}", placed, dict)
    return nodes, members


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every member, from the packs alone.

    A pack is read by start; what a node's ancestors gave is kept as hash states by depth, not as text. Null
    conversations, empty and very long texts and copies come back as they went in; no members give no rows.
    """

    def row(state: dict, r: dict) -> list[dict]:
        if state.get("pack", state) != r["pack"]:
            state.update(pack=r["pack"], stack=[])
        stack = state["stack"]
        del stack[r["depth"] :]
        if len(stack) != r["depth"]:
            raise ValueError(f"pack {r['pack']} has no ancestor of the node at {r['start']}")
        turns, loss, chars, total = (stack[-1][0].copy(), stack[-1][1].copy(), *stack[-1][2:]) if stack else (hashlib.sha256(), hashlib.sha256(), 0, 0)
        role, text = parsed(r["segment"])
        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in r["loss"]:
            masked = unescaped(r["segment"][span["start"] - r["start"] : span["end"] - r["start"]])
            loss.update(masked.encode("utf-8", "surrogatepass"))
            chars += len(masked)
        total += len(r["segment"])
        stack.append((turns, loss, chars, total))
        if r["path_id"] is None:
            return []
        return [{"path_id": r["path_id"], "n_turns": len(stack), "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total}]

    dealt = nodes.select("pack", "start", "depth", "loss", "segment", "path_id").repartition("pack").sortWithinPartitions("pack", "start")
    found = stream(dealt, "path_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", row, dict)
    return members.join(found, "path_id").drop("path_id")
