"""Quality rules: robust multivariate outliers.

Each text gives a vector of transformed statistics. Every (language, source) group gets a minimum-covariance-
determinant estimate: the mean and covariance of that share `coverage` of its rows whose covariance has the smallest
determinant. A bounded sample of the group is searched from many random starts; the best of them go through
concentration steps over all rows (the nearest rows to one estimate give the next) until the determinant settles, and
the smallest one is kept. A step is one aggregation: distances are summed into fine bins with the moments of their
rows, with partial sums on the map side, so a group that holds a third of all rows costs its tasks no more than
another. Small groups are held against their language's estimate, or that of all rows. Rows beyond a chi-square
quantile of the squared Mahalanobis distance, scaled so that the group's median distance is the chi-square median,
are rejected.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import count
from math import sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._shared import as_bytes, col_of, map_texts, passing, row_key, without_rows, written

#: Fixed by the contract: white space, and the characters that count as symbols.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOL = bytes(sorted({*range(256)} - {*SYMBOLS}))
NOT_WORD_START = BLANK + bytes(range(0x80, 0xC0))

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least standard deviations of the five transformed statistics: what differs by less is no outlier, and a
#: statistic that is constant in a group leaves the covariance regular.
FLOORS = (0.25, 0.1, 0.2, 0.1, 0.1)
SIZE = len(FLOORS)
#: The key of the estimate over all rows; those of groups begin with g, of languages with l.
EVERY = "all"
#: Bins of the squared distance a doubling of 1 + d: rows of one bin differ by about one in a hundred.
FINE = 64
#: The determinant has settled when a step lowers its logarithm by less.
SETTLED = 1e-2


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    if int(ids.max()) < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        _, pairs = np.unique((ids[:-2] << 32) | ids[1:-1], return_inverse=True)
        keys = (pairs << 32) | ids[2:]
    held = np.sort(keys)
    if not (held[1:] == held[:-1]).any():
        return 0
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    at = np.flatnonzero(counts[inverse] >= 2)
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANK)]
    return len(lines) - len(set(lines))


def statistics_of(texts: list[bytes | None]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {s: [] for s in STATS}
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    for t in texts:
        t = t or b""
        words = t.split()
        out["n_words"].append(len(words))
        out["word_chars"].append(len(t.translate(None, NOT_WORD_START)))
        out["n_symbols"].append(len(t.translate(None, NOT_SYMBOL)))
        out["n_dup_lines"].append(duplicate_lines(t))
        out["n_repeat_words"].append(repeated_words(np.array(list(map(number.__getitem__, words)), np.int64)))
    return out


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(doc_id, grp, lang, the five statistics) of every row; nulls of language and source form groups of their own."""
    kind = docs.schema[id_col].dataType.simpleString()
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.concat_ws("\x01", part(lang_col), part(source_col)).alias("grp"), part(lang_col).alias("lang"), as_bytes(text_col).alias("text"))

    def start():
        return lambda batch: {"doc_id": col_of(batch, "doc_id"), "grp": col_of(batch, "grp"), "lang": col_of(batch, "lang")} | statistics_of(col_of(batch, "text").to_pylist())

    return map_texts(source, "text", f"doc_id {kind}, grp string, lang string, " + ", ".join(f"{s} long" for s in STATS), start)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: logs of counts and ratios, shares as they are."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words"), F.log1p(F.col("word_chars") / words), F.log1p(10 * F.col("n_symbols") / words), F.col("n_dup_lines") / words * 10, F.col("n_repeat_words") / words]


def chi2_quantile(p: float, k: int = SIZE) -> float:
    """Wilson and Hilferty's approximation."""
    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * sqrt(2 / (9 * k))) ** 3


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. to the group's `mean` under its `inv`; null where the group has none."""
    d = [F.col(f"x{i}") - F.get("mean", F.lit(i)) for i in range(SIZE)]
    return reduce(Column.__add__, [F.get("inv", F.lit(i * SIZE + j)) * d[i] * d[j] for i in range(SIZE) for j in range(SIZE)])


UPPER = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
FIT = "grp string, start int, mean array<double>, inv array<double>, logdet double"


def moments(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and the logarithm of its determinant, from sums over `n` rows; the floors keep it regular."""
    mean = sums / n
    cov = np.zeros((SIZE, SIZE))
    for (i, j), p in zip(UPPER, products, strict=True):
        cov[i, j] = cov[j, i] = p / n - mean[i] * mean[j]
    cov += np.diag(np.square(FLOORS))
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def fit_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    return moments(len(x), x.sum(0), np.array([(x[:, i] * x[:, j]).sum() for i, j in UPPER]))


def concentrated(x: np.ndarray, fit: tuple, held: int, steps: int) -> tuple:
    """`fit` after so many concentration steps over the rows of x."""
    for _ in range(steps):
        d = x - fit[0]
        near = np.argpartition(np.einsum("ni,ij,nj->n", d, fit[1], d), held - 1)[:held] if held < len(x) else slice(None)
        fit = fit_of(x[near])
    return fit


def searched(x: np.ndarray, coverage: float, starts: int, keep: int, seed: int = 5) -> list[tuple]:
    """The best estimates of a sample, from the median of all rows and from random sets of SIZE + 1 rows, smallest determinant first."""
    held = min(len(x), max(1, int(np.ceil(coverage * len(x)))))
    draw = np.random.default_rng(seed)
    middle = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), FLOORS)
    tried = [concentrated(x, (middle, np.diag(1 / np.square(spread)), 0.0), held, 2)]
    for _ in range(starts):
        tried.append(concentrated(x, fit_of(x[draw.choice(len(x), min(len(x), SIZE + 1), replace=False)]), held, 2))
    best = sorted(tried, key=lambda f: f[2])[: 2 * keep]
    return sorted((concentrated(x, f, held, 8) for f in best), key=lambda f: f[2])[:keep]


def estimates(rows: DataFrame, coverage: float, max_start: int, starts: int, max_steps: int) -> DataFrame:
    """(grp, mean, inv, scale) of every group; rows: grp, x0.. ."""
    xs = [f"x{i}" for i in range(SIZE)]
    order = Window.partitionBy("grp").orderBy(F.xxhash64(*xs), *xs)
    sample = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_start).select("grp", *xs)

    def search(table: pa.Table) -> pa.Table:
        x = np.stack([table.column(c).to_numpy() for c in xs], 1)
        found = searched(x, coverage, starts, 2)
        return pa.table({"grp": table.column("grp").slice(0, 1).to_pylist() * len(found), "start": pa.array(range(len(found)), pa.int32()), "mean": [f[0].tolist() for f in found], "inv": [f[1].ravel().tolist() for f in found], "logdet": [f[2] for f in found]})

    def solve(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sums, products = (np.stack([table.column(c).to_numpy() for c in names], 1) if len(table) else np.zeros((0, len(names))) for names in ([f"s{i}" for i in range(SIZE)], [f"s{i}_{j}" for i, j in UPPER]))
            fits = [moments(n, s, q) for n, s, q in zip(table.column("n").to_pylist(), sums, products, strict=True)]
            columns = [table.column("grp").to_pylist(), table.column("start").to_pylist(), [f[0].tolist() for f in fits], [f[1].ravel().tolist() for f in fits], [f[2] for f in fits]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()), strict=True)], names=["grp", "start", "mean", "inv", "logdet"])

    active, settled = written(sample.groupBy("grp").applyInArrow(search, FIT), "mcd"), []
    for _ in range(max_steps):
        far = rows.join(active.drop("logdet"), "grp").withColumn("bin", F.floor(F.log2(1 + distance()) * FINE).cast("int"))
        sums = far.groupBy("grp", "start", "bin").agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)], *[F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"s{i}_{j}") for i, j in UPPER])
        own = Window.partitionBy("grp", "start")
        before = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        near = sums.withColumn("all", F.sum("n").over(own)).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < coverage * F.col("all"))
        held = near.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(SIZE)], *[f"s{i}_{j}" for i, j in UPPER]]])
        made = held.mapInArrow(solve, FIT).join(active.select("grp", "start", F.struct("mean", "inv", "logdet").alias("was")), ["grp", "start"])
        # the sample's determinant is not that of all rows, so a first step always counts
        moved = F.lit(True) if not settled else F.col("logdet") < F.col("was.logdet") - SETTLED
        made = written(made.select("grp", "start", F.when(moved, F.struct("mean", "inv", "logdet")).otherwise(F.col("was")).alias("f"), moved.alias("moved")).select("grp", "start", "f.*", "moved"), "mcd")
        settled.append(made.where("not moved").drop("moved"))
        active = made.where("moved").drop("moved")
        if active.isEmpty():
            break
    fits = reduce(DataFrame.unionByName, [*settled, active])
    fit = written(fits.groupBy("grp").agg(F.min_by(F.struct("mean", "inv", "logdet"), F.struct("logdet", "start")).alias("f")).select("grp", "f.*"), "mcd")
    scale = rows.join(fit, "grp").groupBy("grp").agg(F.percentile_approx(distance(), 0.5, 2000).alias("median"))
    return written(fit.join(scale, "grp").select("grp", "mean", "inv", F.greatest(F.col("median") / chi2_quantile(0.5), F.lit(1.0)).alias("scale")), "mcd")


def pooled_estimates(rows: DataFrame, groups: DataFrame, least: int, *options) -> DataFrame:
    """(grp, mean, inv, scale) of every group in `groups` (grp, lang): its own estimate where `rows` (grp, lang, x0..) hold `least` rows of it, else its language's likewise, else that over all rows."""
    counts = groups.select("grp", "lang").distinct().join(rows.groupBy("grp").agg(F.count("*").alias("n")), "grp", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("of_lang"), F.min("n").alias("smallest"))
    keyed = counts.join(langs, "lang")
    own = F.when(F.col("n") >= least, F.concat(F.lit("g"), "grp"))
    spoken = F.when((F.col("smallest") < least) & (F.col("of_lang") >= least), F.concat(F.lit("l"), "lang"))
    keyed = written(keyed.select("grp", own.alias("own"), spoken.alias("spoken"), F.coalesce(own, spoken, F.lit(EVERY)).alias("key")), "keys")
    every = F.lit(None).cast("string") if keyed.where(F.col("key") == EVERY).isEmpty() else F.lit(EVERY)
    feeds = keyed.select("grp", F.filter(F.array("own", "spoken", every), lambda k: k.isNotNull()).alias("feeds"))
    fit = estimates(rows.join(feeds, "grp").select(F.explode("feeds").alias("grp"), *[f"x{i}" for i in range(SIZE)]), *options)
    return keyed.select("grp", "key").join(fit.withColumnRenamed("grp", "key"), "key").drop("key")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", coverage: float = 0.75, least: int = 50, tail: float = 1e-6, max_start: int = 600, starts: int = 40, max_steps: int = 30) -> DataFrame:
    """(doc_id, the five statistics, base_failed, distance, kept) for each row.

    base_failed: fewer than 50 words, or over half of the words repeated. Others are rejected if their scaled
    squared distance passes the 1 - `tail` quantile. Rows that fail the base rules do not shape the estimates; groups
    of fewer than `least` others are held against the estimate of their language, or where that has fewer too, of all
    rows, so every row has a distance; only in a table whose rows all fail has none one. The search for starts looks
    at up to `max_start` rows a group; all rows take part in the steps that follow, at most `max_steps`. Null and
    empty texts have no words, so they fail; null languages or sources are groups of their own; a null id stays null;
    repeated rows each get a row. Other columns are not read.
    """
    with passing(docs.sparkSession):
        stats = written(measured(docs, id_col, text_col, lang_col, source_col), "statistics")
        with_x = stats.select("*", *[x.alias(f"x{i}") for i, x in enumerate(vector())], base_failed().alias("base_failed"))
        fit = pooled_estimates(with_x.where("not base_failed"), stats, least, coverage, max_start, starts, max_steps)
        far = with_x.join(fit, "grp", "left").withColumn("distance", distance() / F.col("scale"))
        kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(1 - tail), F.lit(True))
        return written(far.select("doc_id", *STATS, "base_failed", "distance", kept.alias("kept")), "verdicts", keep=True)


def without_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without its rejected rows, each by its own id, text, language and source, null and repeated ids too; columns stay."""
    columns = [options.get("lang_col", "lang"), options.get("source_col", "source")]
    key = row_key(id_col, text_col, *columns)
    keyed = docs.select(key.alias("__row"), *[F.col(f"`{c}`") for c in dict.fromkeys([text_col, *columns])])
    return without_rows(docs, quality_rules(keyed, "__row", text_col, **options).where("not kept").select("doc_id"), key)
