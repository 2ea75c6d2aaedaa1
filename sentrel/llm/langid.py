"""Language identification by a bidirectional gated recurrent network over bytes.

A text is its letters in lower case, other ASCII being single blanks. The network reads windows of it in both
directions, across words; a window is OWN bytes that are labelled, each once, between EDGE bytes of context that only
lead the network in. A document's probabilities are the mean over all its positions. Training is numpy
back-propagation through time on the driver, over windows of a bounded sample of labelled documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import BROADCAST_IDS, as_bytes, col_of, map_texts, passing, written

#: A-Z become a-z; other ASCII than letters is a blank.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
OWN, EDGE = 120, 8
#: Windows are read so many at once, fewer where the labels are many.
ROWS = 2048
LOGITS = 4_000_000


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Reader:
    """One direction of gated recurrent units over byte indices."""

    def __init__(self, hidden: int, draw: np.random.Generator):
        self.w = (draw.standard_normal((256, 3 * hidden)) * 0.1).astype(np.float32)
        self.u = (draw.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(3 * hidden, np.float32)

    def read(self, x: np.ndarray):
        """The state (hidden, rows) after each byte of x (time, rows), one after the other: the same array each time."""
        n, rows = self.u.shape[0], x.shape[1]
        half = np.where(np.arange(3 * n) < 2 * n, 0.5, 1).astype(np.float32)  # sigmoid(v) is (1 + tanh(v / 2)) / 2
        w, u = np.ascontiguousarray(((self.w + self.b) * half).T), np.ascontiguousarray((self.u * half).T)
        a, r = np.empty((3 * n, rows), np.float32), np.empty((3 * n, rows), np.float32)
        c, d, h = np.empty((n, rows), np.float32), np.empty((n, rows), np.float32), np.zeros((n, rows), np.float32)
        gates = r[: 2 * n]
        for now in x:
            np.take(w, now, axis=1, out=a, mode="clip")
            np.matmul(u, h, out=r)
            gates += a[: 2 * n]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            np.multiply(gates[n:], r[2 * n :], out=c)
            c += a[2 * n :]
            np.tanh(c, out=c)
            np.subtract(h, c, out=d)
            d *= gates[:n]
            np.add(c, d, out=h)
            yield h

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, rows, hidden) after each byte of x (rows, time)."""
        rows, steps = x.shape
        n = self.u.shape[0]
        h = np.zeros((rows, n), np.float32)
        states, held = np.empty((steps, rows, n), np.float32), []
        inputs = self.w + self.b
        for t in range(steps):
            a, r = inputs[x[:, t]], h @ self.u
            gates = sigmoid(a[:, : 2 * n] + r[:, : 2 * n])
            z, o = gates[:, :n], gates[:, n:]
            c = np.tanh(a[:, 2 * n :] + o * r[:, 2 * n :])
            new = c + z * (h - c)
            if keep:
                held.append((h, z, o, c, r[:, 2 * n :]))
            h = states[t] = new
        return states, held

    def backward(self, x: np.ndarray, held: list, d_states: np.ndarray) -> list[np.ndarray]:
        n = self.u.shape[0]
        dw, du, db = np.zeros_like(self.w), np.zeros_like(self.u), np.zeros_like(self.b)
        dh = np.zeros_like(d_states[0])
        inputs = np.empty((x.shape[1], len(x), 3 * n), d_states.dtype)
        for t in range(x.shape[1] - 1, -1, -1):
            h, z, o, c, r = held[t]
            dh = dh + d_states[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            do = dc * r * o * (1 - o)
            da = np.concatenate([dz, do, dc], 1)
            dr = np.concatenate([dz, do, dc * o], 1)
            inputs[t] = da
            db += da.sum(0)
            du += h.T @ dr
            dh = dh * z + dr @ self.u.T
        flat = x.T.ravel()
        order = np.argsort(flat, kind="stable")
        values, starts = np.unique(flat[order], return_index=True)
        dw[values] = np.add.reduceat(inputs.reshape(-1, 3 * n)[order], starts, axis=0)
        return [dw, du, db]


class Network:
    def __init__(self, labels: list[str], hidden: int, seed: int):
        draw = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Reader(hidden, draw), Reader(hidden, draw)
        self.v = (draw.standard_normal((2 * hidden, len(labels))) * 0.1).astype(np.float32)
        self.c = np.zeros(len(labels), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.u, self.ahead.b, self.back.w, self.back.u, self.back.b, self.v, self.c]

    def positions(self, x: np.ndarray, keep: bool = False):
        """Probabilities (rows, time, labels) of every position."""
        first, held1 = self.ahead.forward(x, keep)
        second, held2 = self.back.forward(x[:, ::-1], keep)
        both = np.concatenate([first, second[::-1]], 2).transpose(1, 0, 2)
        logits = both @ self.v + self.c
        p = np.exp(logits - logits.max(2, keepdims=True))
        return p / p.sum(2, keepdims=True), (both, held1, held2)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy of all positions."""
        p, (both, held1, held2) = self.positions(x, True)
        d = p
        d[np.arange(len(x)), :, y] -= 1
        d /= x.size
        flat, wide = d.reshape(-1, d.shape[2]), both.reshape(-1, both.shape[2])
        states = (d @ self.v.T).transpose(1, 0, 2)
        n = self.ahead.u.shape[0]
        return [*self.ahead.backward(x, held1, states[:, :, :n]), *self.back.backward(x[:, ::-1], held2, states[::-1, :, n:]), wide.T @ flat, flat.sum(0)]

    def pooled(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(windows, labels): sums of the probabilities of each window's own positions; x: (windows, EDGE + OWN + EDGE), own: how many count."""
        out = np.empty((len(x), len(self.labels)))
        rows = max(32, min(ROWS, LOGITS // (OWN * len(self.labels))))
        hidden = self.ahead.u.shape[0]
        first, second = np.ascontiguousarray(self.v[:hidden].T), np.ascontiguousarray(self.v[hidden:].T)
        for k in range(0, len(x), rows):
            now = np.ascontiguousarray(x[k : k + rows].T)
            logits = np.empty((OWN, len(self.labels), now.shape[1]), np.float32)
            for t, h in enumerate(self.ahead.read(now[: EDGE + OWN])):
                if t >= EDGE:
                    np.matmul(first, h, out=logits[t - EDGE])
            for t, h in enumerate(self.back.read(now[: EDGE - 1 : -1])):
                if t >= EDGE:
                    logits[OWN - 1 - (t - EDGE)] += second @ h
            logits += self.c[:, None]
            logits -= logits.max(1, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(1, keepdims=True)
            short = own[k : k + rows] < OWN
            if short.any():
                logits *= (np.arange(OWN)[:, None] < own[k : k + rows])[:, None, :]
            out[k : k + rows] = logits.sum(0, dtype=np.float64).T
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        found = [letters_of(t) if t else b"" for t in texts]
        able = [i for i, f in enumerate(found) if f and has_letter(f)]
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        if able:
            parts = [windows_of(found[i]) for i in able]
            sums = self.pooled(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            totals = np.add.reduceat(sums, np.cumsum([0, *[len(p[0]) for p in parts]])[:-1], axis=0)
            for i, total in zip(able, totals, strict=True):
                best = int(total.argmax())
                labels[i], scores[i] = self.labels[best], min(1.0, float(total[best] / total.sum()))
        return labels, scores

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> None:
        """Adam over batches of windows (rows, time), in an order that the seed draws."""
        draw = np.random.default_rng(seed)
        first, second = ([np.zeros_like(w) for w in self.weights()] for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = draw.permutation(len(x))
            for k in range(0, len(x), batch):
                own = order[k : k + batch]
                step += 1
                for w, m, s, g in zip(self.weights(), first, second, self.gradients(x[own], y[own]), strict=True):
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    w -= rate / (1 + epoch) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)


def letters_of(text: bytes) -> bytes:
    """The text as the network reads it: letters in lower case, one blank between runs."""
    return b" ".join(text.translate(TABLE).split())


def has_letter(letters: bytes) -> bool:
    """ASCII that is left is letters; beyond it a character may be any symbol."""
    return any(0x61 <= b <= 0x7A for b in letters[:200]) or any(c.isalpha() for c in letters.decode("utf-8", "replace"))


def windows_of(letters: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows, EDGE + OWN + EDGE) and how many of each window's own positions the text fills; every position is some window's own once."""
    n = -(-len(letters) // OWN)
    padded = np.full(EDGE + n * OWN + EDGE, 0x20, np.uint8)
    padded[EDGE : EDGE + len(letters)] = np.frombuffer(letters, np.uint8)
    own = np.full(n, OWN)
    own[-1] = len(letters) - (n - 1) * OWN
    return np.lib.stride_tricks.sliding_window_view(padded, EDGE + OWN + EDGE)[::OWN], own


def held_out(id_col: str):
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, per_doc: int, span: int) -> tuple[list[bytes], list[str]]:
    """Stretches of `span` bytes of the `per_lang` documents of every language whose ids have the smallest hashes, `per_doc` of each spread over its whole text."""
    able = docs.where(~held_out(id_col) & F.col(f"`{id_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull())
    lang, own = F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").cast("string")
    first = Window.partitionBy("lang").orderBy("h", "id")

    def start():
        def of(batch: pa.RecordBatch) -> dict:
            out = []
            for t in col_of(batch, "text").to_pylist():
                letters = letters_of(t)
                stride = max(span, -(-len(letters) // per_doc))
                out.append([letters[k : k + span] for k in range(0, len(letters), stride)])
            return {"lang": col_of(batch, "lang"), "parts": out}

        return of

    with passing(docs.sparkSession):
        chosen = able.where(F.col(f"`{text_col}`").isNotNull()).select(lang, F.xxhash64(own).alias("h"), own.alias("id")).withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_lang)
        chosen = written(chosen.select("lang", "id").distinct(), "chosen")
        same = (lang == F.col("__lang")) & (own == F.col("__id"))
        ids = chosen.toDF("__lang", "__id")
        few = able.where(F.col(f"`{text_col}`").isNotNull()).join(F.broadcast(ids) if chosen.count() <= BROADCAST_IDS else ids, same, "left_semi").groupBy(lang, own.alias("id")).agg(F.min(as_bytes(text_col)).alias("text"))
        rows = map_texts(few.select("lang", "text"), "text", "lang string, parts array<binary>", start).collect()
    return [bytes(w) for r in rows for w in r.parts], [r.lang for r in rows for _ in r.parts]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 500, per_doc: int = 8, span: int = 48, hidden: int = 8, epochs: int = 4, seed: int = 11) -> Network | None:
    """A network from the documents that are not held out; None where none has a language.

    Of each language `per_lang` documents are read at most (those of the smallest id hashes, ties by id; of rows
    that share an id the one of the smallest text), of each `per_doc` stretches; null and empty texts give none. Ties in the order of the sample are broken by bytes.
    """
    parts, langs = sample(docs, id_col, text_col, lang_col, per_lang, per_doc, span)
    if not parts:
        return None
    names = sorted(set(langs))
    order = sorted(range(len(parts)), key=lambda i: (parts[i], langs[i]))  # the executors' order doesn't matter
    x = np.frombuffer(b"".join(parts[i].ljust(span) for i in order), np.uint8).reshape(-1, span)
    network = Network(names, hidden, seed)
    network.train(x, np.array([names.index(langs[i]) for i in order]), epochs, 128, 0.03, seed)
    return network


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row, from the whole text alone.

    Null, empty and letterless texts, and all texts where no language was learned, are `und` with score 0. A null
    id stays null and is not held out; repeated rows each get a row, an empty table gives none; of equal scores the
    first label counts. Very long texts are read whole, window by window; other columns, whatever their names, are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def start():
        network = shared.value

        def of(batch: pa.RecordBatch) -> dict:
            texts = col_of(batch, "text").to_pylist()
            labels, scores = network.predict(texts) if network else (["und"] * len(texts), [0.0] * len(texts))
            return {"doc_id": col_of(batch, "doc_id"), "held_out": col_of(batch, "held_out"), "lang_pred": labels, "score": scores}

        return of

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), as_bytes(text_col).alias("text"))
    return map_texts(source, "text", f"doc_id {kind}, held_out boolean, lang_pred string, score double", start)
