"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Hashed words and symbol runs of a text share one weight vector; ordered thresholds part the grades:
P(grade <= k) = sigmoid(threshold_k - score). It gives the expected grade and the probability of the top grade. It
is fitted on the driver with numpy over a bounded sample of rated documents; scoring runs over all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, col_of, map_texts

BITS = 24
#: Digits and letters, A-Z as a-z; and what is neither these nor white space.
WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SYMBOL = bytes(0x20 if chr(b).isalnum() or b >= 0x80 else b for b in range(256))
KNOWN_WORDS = 1_000_000


def features(text: bytes | None) -> set[bytes]:
    """The distinct words, and the distinct symbol runs (marked) of a text."""
    if not text:
        return set()
    return set(text.translate(WORD).split()).union(b"\0" + s for s in set(text.translate(SYMBOL).split()))


def bucket(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Ordinal:
    """Weights of the buckets that were fitted, and the ordered thresholds."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.weight = dict(zip(buckets.tolist(), weights.tolist(), strict=True))
        self.thresholds = thresholds

    def above(self, scores: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): P(grade > k)."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(rows: list[list[int]], grades: np.ndarray, least: int = 4, steps: int = 250, rate: float = 0.1, sparse: float = 3e-4) -> Ordinal | None:
    """Full-batch Adam on the cumulative-link likelihood with an L1 penalty `sparse`, so that only words that tell keep a weight; buckets in fewer than `least` rows are left out. None with one grade only."""
    top = int(grades.max(initial=0))
    if not len(rows) or len(set(grades.tolist())) < 2:
        return None
    flat = np.array([b for r in rows for b in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    buckets, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    often = counts >= least
    keep = often[column]
    renumber = np.cumsum(often) - 1
    column, owner, buckets = renumber[column[keep]], owner[keep], buckets[often]
    w = np.zeros(len(buckets))
    share = np.array([(grades <= k).mean() for k in range(top)]).clip(0.01, 0.99)
    start = np.log(share / (1 - share))
    gaps = np.r_[start[0], np.log(np.maximum(np.diff(start), 0.1))]  # thresholds: the first, then positive steps
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(gaps), np.zeros_like(gaps)]
    for step in range(1, steps + 1):
        limits = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])
        score = np.bincount(owner, w[column], len(rows))
        cdf = sigmoid(np.c_[np.full(len(rows), -np.inf), limits[None, :] - score[:, None], np.full(len(rows), np.inf)].clip(-50, 50))
        cdf[:, 0], cdf[:, -1] = 0, 1
        slope = cdf * (1 - cdf)
        at = np.arange(len(rows))
        p = np.maximum(cdf[at, grades + 1] - cdf[at, grades], 1e-9)
        d_score = (slope[at, grades + 1] - slope[at, grades]) / p / len(rows)  # of the negative log-likelihood
        d_limit = np.zeros(top)
        for k in range(top):
            d_limit[k] = -(slope[grades == k, k + 1] / p[grades == k]).sum() + (slope[grades == k + 1, k + 1] / p[grades == k + 1]).sum()
        d_limit /= len(rows)
        d_gap = np.array([d_limit[k:].sum() for k in range(top)]) * np.r_[1.0, np.exp(gaps[1:])]
        d_w = np.bincount(column, d_score[owner], len(w))
        for value, grad, m, s in ((w, d_w, state[0], state[1]), (gaps, d_gap, state[2], state[3])):
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            pace = rate / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            value -= pace * (m / (1 - 0.9**step))
            if value is w:
                w[:] = np.sign(w) * np.maximum(np.abs(w) - pace * sparse, 0)
    told = w != 0
    buckets, w = buckets[told], w[told]
    return Ordinal(buckets, w, np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])]))


def rated(docs: DataFrame, ratings: DataFrame, grade, id_col: str, text_col: str, max_rated: int) -> tuple[list[list[int]], np.ndarray]:
    """Feature buckets and grades of at most about `max_rated` rated documents, those with the smallest id hashes."""
    held = ratings.select(F.col(f"`{id_col}`").alias("id"), grade.cast("int").alias("grade")).where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").alias("grade"))
    few = held.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_rated)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), as_bytes(text_col).alias("text")).join(F.broadcast(few), "id").select("grade", "text")

    def start():
        return lambda batch: {"grade": col_of(batch, "grade"), "buckets": [sorted({bucket(w) for w in features(t)}) for t in col_of(batch, "text").to_pylist()]}

    rows = map_texts(texts, "text", "grade int, buckets array<int>", start).limit(2 * max_rated).collect()
    rows.sort(key=lambda r: (r.grade, r.buckets))
    return [r.buckets for r in rows], np.array([r.grade for r in rows], np.int64)


def train(docs: DataFrame, ratings: DataFrame, grade, id_col: str = "doc_id", text_col: str = "text", max_rated: int = 6000) -> Ordinal | None:
    """A classifier from `ratings`; `grade` is a column of them that gives 0, 1, ...

    A document that is rated twice counts with its lower grade; ratings of a null id or grade, and of ids that no
    document has, do not count; documents that share a rated id each count. At most about `max_rated` ratings train,
    those of the smallest id hashes, ties by id. Null and empty texts have no features. With an empty table, or one
    grade only, there is no model (None).
    """
    return fit(*rated(docs, ratings, grade, id_col, text_col, max_rated))


def grade_documents(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", least_tail: float = 0.5) -> DataFrame:
    """(doc_id, grade: expected, tail: probability of the top grade, kept: tail >= least_tail) for each row, from whole texts.

    Null and empty texts have score 0, so their grade is what the thresholds alone give. Without a model grade and
    tail are null and every row is kept. A null id stays null; repeated rows each get a row, an empty table gives none.
    A very long text is one row of one task. Other columns, whatever their names, are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        held = shared.value
        known: dict[bytes, float] = {}

        def of(batch: pa.RecordBatch) -> dict:
            ids, texts = col_of(batch, "doc_id"), col_of(batch, "text").to_pylist()
            if held is None:
                return {"doc_id": ids, "grade": [None] * len(texts), "tail": [None] * len(texts), "kept": [True] * len(texts)}
            if len(known) > KNOWN_WORDS:
                known.clear()
            scores = []
            for t in texts:
                own = features(t)
                for w in own:
                    if w not in known:
                        known[w] = held.weight.get(bucket(w), 0.0)
                scores.append(sum(map(known.__getitem__, own)))
            above = held.above(np.array(scores, np.float64))
            return {"doc_id": ids, "grade": above.sum(1), "tail": above[:, -1], "kept": above[:, -1] >= least_tail}

        return of

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_texts(source, "text", f"doc_id {kind}, grade double, tail double, kept boolean", start)
