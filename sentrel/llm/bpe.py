"""BPE encoding and decoding by a pair occurrence index.

All new chunks of a slice are laid out as one row of linked symbols. An index maps each rank (a pair that can be
merged) to the positions where it stands; active ranks are taken from a heap in ascending order, their positions
merged at once, and the pairs that arise left and right are entered under their own ranks. Merges never cross a
word, so this order gives each word what its own lowest-rank-first merging gives.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, col_of, map_texts

#: Fixed values of the vocabulary's text pipeline: its white space (Unicode White_Space) and its word pattern.
SPACE = r"[\t-\r \x85\xa0  -     　]+"
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Bytes of text that are encoded at once: each slice passes all its ranks once, so larger ones cost less.
SLICE = 2 << 20
#: str.split() also parts at these, which are not White_Space.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Bytes (about) that a generation of a task's memory holds before it becomes the old one; two are kept. Longer chunks are encoded anew each time.
KNOWN_BYTES = 8 << 20
KNOWN_LENGTH = 100

#: Fixed by the library's Unicode version. Code points that are letters or numbers in later versions only: symbols here.
LATE = regex.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5"
    "\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Lower case that Python's tables don't have yet: first, last, and how far the small letter lies (single ones by what they are).
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
BEYOND_LATIN = regex.compile("[\u0558-\U0010ffff]")


#: Fixed by the library's Unicode version. Marks that later versions move into canonical order or compose: here they stay where they are, and nothing moves across them.
LATE_MARKS = regex.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27\U00010eab\U00010eac"
    "\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839\U0001183a\U00011930\U0001193d\U0001193e\U00011943"
    "\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f"
    "\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next letter from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Vocabulary:
    """A word BPE vocabulary with an end-of-word mark, read from its public file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        mark = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.path, self.size = path, 1 + max([*vocab.values(), *self.special.values()])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + mark] for c in letters], np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.pairs = keys[order], order, keys  # pairs: by rank
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @cached_property
    def tokens(self) -> list[str]:
        """Each id's token; only decoding needs them."""
        with open(self.path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        out = [""] * self.size
        for token, i in [*vocab.items(), *self.special.items()]:
            out[i] = token
        return out

    @cached_property
    def names(self) -> list[str]:
        """Each id in decimal; only ids as texts need them."""
        return [str(i) for i in range(self.size)]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def words(self, chunk: str) -> list[str | int]:
        """The words of a chunk without white space; special tokens as their ids."""
        if self.split is None or "<|" not in chunk:
            return parted(normal(chunk))
        out: list[str | int] = []
        for part in self.split.split(chunk):
            out += [self.special[part]] if part in self.special else parted(normal(part))
        return out


def normal(chunk: str) -> str:
    """NFC, then lower case letter by letter (no final sigma)."""
    if chunk.isascii():
        return chunk.lower()
    beyond = BEYOND_LATIN.search(chunk) is not None  # else there are neither late marks nor new letters, in the chunk or made of it
    if beyond and LATE_MARKS.search(chunk):
        chunk = "".join(unicodedata.normalize("NFC", part) for part in LATE_MARKS.split(chunk))
    else:
        chunk = unicodedata.normalize("NFC", chunk)
    low = (chunk.replace("Σ", "σ") if "Σ" in chunk else chunk).lower()
    return low.translate(NEW_LOWER) if beyond else low


def parted(text: str) -> list[str]:
    """The words of a normalised chunk. Late letters and numbers are symbols: a symbol takes their place while the words are found."""
    if text.isascii() or not LATE.search(text):
        return WORDS.findall(text)
    return [text[m.start() : m.end()] for m in WORDS.finditer(LATE.sub("\xa4", text))]


def merge_all(symbols: np.ndarray, ends: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Merge in place by ascending rank; ends: True at a word's last symbol. Returns which positions remain."""
    n = len(symbols)
    alive = np.ones(n, bool)
    after = np.arange(1, n + 1)
    after[ends] = -1
    before = np.arange(-1, n - 1)
    before[1:][ends[:-1]] = -1
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def enter(left: np.ndarray) -> None:
        """Index the pairs that start at these positions."""
        ranks = vocab.rank(symbols[left], symbols[after[left]])
        keep = ranks >= 0
        if not keep.any():
            return
        left, ranks = left[keep], ranks[keep]
        order = np.argsort(ranks, kind="stable")
        left, ranks = left[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for part, r in zip(np.split(left, cuts), ranks[np.r_[0, cuts]].tolist(), strict=True):
            if r not in index:
                heapq.heappush(heap, r)
            index[r].append(part)

    enter(np.flatnonzero(after >= 0))
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        key = int(vocab.pairs[r])
        a, b = key >> 32, key & 0xFFFFFFFF
        at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
        at = at[alive[at] & (symbols[at] == a)]
        right = after[at]
        held = right >= 0
        at, right = at[held], right[held]
        held = symbols[right] == b
        at, right = at[held], right[held]
        if a == b and len(at) > 1:  # in a run the leftmost pair goes first
            taken = np.zeros(len(at), bool)
            last = -1
            for i, (p, q) in enumerate(zip(at.tolist(), right.tolist(), strict=True)):
                if p != last:
                    taken[i], last = True, q
            at, right = at[taken], right[taken]
        if not len(at):
            continue
        symbols[at] = vocab.merged[r]
        alive[right] = False
        beyond = after[right]
        after[at] = beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        lefts = before[at]
        enter(np.unique(np.concatenate([lefts[lefts >= 0], at[inner]])))
    return alive


class Encoder:
    """Encodes texts; remembers chunks of no white space in two generations, each with its ids (a text, or int32 bytes) and, for decoding, its tokens."""

    def __init__(self, vocab: Vocabulary, as_text: bool, decoded: bool):
        self.vocab, self.as_text, self.decoded = vocab, as_text, decoded
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        if any(c in text for c in ODD):
            return [c for c in regex.split(SPACE, text) if c]
        return text.split()

    def learn(self, new: list[str]) -> list[tuple]:
        """What each new chunk is encoded as: (number of ids, ids, tokens)."""
        v = self.vocab
        words, spans = [], []
        for chunk in new:
            own = v.words(chunk)
            spans.append(len(own))
            words += own
        data = [w.encode() if isinstance(w, str) else b"\0" for w in words]
        sizes = np.array([len(d) for d in data], np.int64)
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.zeros(len(raw), bool)
        stops = np.cumsum(sizes)
        ends[stops - 1] = True
        symbols = np.where(ends, v.last[raw], v.inner[raw])
        fixed = [(s - 1, w) for s, w in zip(stops.tolist(), words, strict=True) if not isinstance(w, str)]
        for at, i in fixed:  # one symbol long, so no pair holds it
            symbols[at] = i
        alive = merge_all(symbols, ends, v)
        kept = symbols[alive]
        upto = np.r_[0, np.cumsum(alive)][np.r_[0, stops]]  # tokens before each word's end
        bounds = upto[np.r_[0, np.cumsum(spans)]].tolist()
        if self.as_text:
            names = [v.names[i] for i in kept.tolist()]
            ids = [" ".join(names[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
        else:
            flat = kept.astype(np.int32)
            ids = [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
        tokens = [" ".join([v.tokens[i] for i in kept[a:b].tolist()]) for a, b in zip(bounds, bounds[1:], strict=False)] if self.decoded else [""] * len(ids)
        return [(b - a, x, t) for a, b, x, t in zip(bounds, bounds[1:], ids, tokens, strict=False)]

    def keep(self, chunk: str, found: tuple) -> None:
        if len(chunk) <= KNOWN_LENGTH:
            self.young[chunk] = found
            self.held += 300 + 2 * len(chunk) + len(found[1]) + len(found[2])

    def encode(self, texts: list[str]) -> tuple[list[int], list, list[str]]:
        """The number of tokens, the ids and, for decoding, the tokens joined by a space of each text."""
        if self.held > KNOWN_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        here, new = {}, []
        for c in set().union(*map(self.chunks, texts)):
            found = self.young.get(c)
            if found is None:
                found = self.old.get(c)
                if found is None:
                    new.append(c)
                    continue
                self.keep(c, found)
            here[c] = found
        if new:
            for c, found in zip(new, self.learn(new), strict=True):
                here[c] = found
                if self.held <= KNOWN_BYTES:
                    self.keep(c, found)
        counts, ids, tokens = [], [], []
        for text in texts:  # split again: the chunks of all texts at once would take many times their bytes
            found = list(map(here.__getitem__, self.chunks(text)))
            counts.append(sum(f[0] for f in found))
            ids.append(" ".join([f[1] for f in found if f[0]]) if self.as_text else b"".join([f[1] for f in found]))
            tokens.append(" ".join([f[2] for f in found if f[0]]) if self.decoded else "")
        return counts, ids, tokens


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One a Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", ids_as: str = "array", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids [, decoded]) for each row: every whole text without added special tokens.

    `ids_as="array"` gives array<int>; "text" gives decimal ids joined by one space. `decoded` adds the text that
    decoding the ids gives, special tokens kept: for this vocabulary (no decoder) its tokens joined by one space.
    Null is as empty: no ids. Special tokens' own strings in a text become those tokens. Repeated rows each get a
    row, an empty table gives none; other columns, whatever their names, are not read. A very long text is encoded in
    slices by one task. Every executor must be able to open `vocab_path`.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    as_array = ids_as == "array"

    def start():
        of = Encoder(vocabulary(vocab_path), not as_array, decoded)

        def work(batch: pa.RecordBatch) -> dict:
            counts, ids, tokens = of.encode([t.decode("utf-8", "replace") if t else "" for t in col_of(batch, "text").to_pylist()])
            if as_array:
                flat = pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(ids))])
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), flat)
            return {"doc_id": col_of(batch, "doc_id"), "n_tokens": counts, "ids": ids} | ({"decoded": tokens} if decoded else {})

        return work

    schema = f"doc_id {kind}, n_tokens long, ids {'array<int>' if as_array else 'string'}" + ", decoded string" * decoded
    return map_texts(docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("text")), "text", schema, start, SLICE)


def decode(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of rows with an array of ids; null ids give null, no ids an empty text, ids outside the vocabulary are skipped.

    Repeated rows each get a row, an empty table gives none; very long arrays are decoded whole, in one task; other
    columns, whatever their names, are not read.
    """

    @F.pandas_udf("string")
    def text(ids):
        tokens = vocabulary(vocab_path).tokens
        return ids.map(lambda own: None if own is None else " ".join(tokens[i] for i in own if 0 <= i < len(tokens)))

    return encoded.select(F.col(f"`{id_col}`").alias("doc_id"), text(F.col(f"`{ids_col}`")).alias("decoded"))
