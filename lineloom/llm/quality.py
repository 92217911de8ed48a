"""Quality scores by a Gaussian-kernel ridge in random Fourier features, calibrated by isotonic regression.

A document becomes 30 statistics of its whole text.  Random Fourier features of the standardised
statistics approximate a Gaussian kernel.  Each partition sums its share of the normal equations,
kept apart by fold; the driver adds those sums (their size depends on the number of features only),
solves the ridge once for all rows and once without each fold, and the scores of rows by the model
that has not seen them are the input of the isotonic calibration.

Nulls, empty texts: scored like a text without words; very long texts count whole.  Repeated ids:
scored row by row, and one row for fitting (that of the smallest hash of its text).  Without labels, or with one
class only, every score is that class' share (0.5 without any label).  An empty table gives no rows;
further columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, labelled, slices

#: Labelled rows that one task sums at least, beyond TASKS tasks: what a task passes on is as large as the equations.
TASK_ROWS, TASKS = 65_536, 8
FEATURES = 256
FOLDS = 4
#: Width of the Gaussian kernel over standardised statistics.
WIDTH = 6.0
RIDGE = 1.0
THRESHOLD = 0.3
#: Frequent short words of four languages.
STOP = frozenset("the of and to in a is that it for on with as was be by this are or an from at de la que el en y los del se las un por con no una su para es al lo le les des et du une est pour dans qui sur au pas plus ne ce il der die und den von zu das mit sich auf ist im dem nicht ein eine als auch".split())
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_SYMBOLS = [ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]
_STOPS = [ord(c) for c in ".!?"]


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, each of a bounded or logarithmic scale."""
    text = text or ""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    n = max(1, len(raw))
    words = text.split()
    m = max(1, len(words))
    seen = Counter(words)
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    freq = np.fromiter(seen.values(), np.float64, len(seen)) if seen else np.ones(1)
    lines = text.split("\n")
    distinct_lines = len(set(lines))
    upper, lower, digit = (int(counts[r.start : r.stop].sum()) for r in (_UPPER, _LOWER, _DIGIT))
    p = counts[counts > 0] / n
    q = freq / freq.sum()
    top = float(freq.max())
    stop = sum(seen[w] for w in STOP.intersection(seen))
    again = sum(map(str.__eq__, words, words[1:]))
    marked = sum(c for w, c in seen.items() if w[-1] in "#$%&*!|")
    upper_words = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    symbols = int(counts[_SYMBOLS].sum())
    other = int(counts[33:127].sum()) - upper - lower - digit
    return [
        math.log1p(len(raw)), math.log1p(len(words)), math.log1p(len(lines)),
        upper / n, lower / n, digit / n, symbols / n, other / n, int(counts[128:].sum()) / n, int(counts[32]) / n,
        math.log1p(1000 * counts[ord("|")] / n), math.log1p(1000 * counts[ord("!")] / n), math.log1p(1000 * symbols / n), math.log1p(1000 * digit / n),
        math.log1p(1000 * int(counts[_STOPS].sum()) / n), math.log1p(1000 * counts[44] / n),
        float(lens.mean()), float(lens.std()), math.log1p(float(lens.max())),
        len(seen) / m, top / m, again / m, stop / m, marked / m, upper_words / m,
        distinct_lines / len(lines), math.log1p(m / len(lines)),
        float(-(p * np.log(p)).sum()) if raw else 0.0, float(-(q * np.log(q)).sum()) / math.log(m + 1.7), math.log1p(float(np.square(freq).sum()) / m),
    ]


N_STATS = len(statistics(""))


def waves(seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of the random Fourier features."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((N_STATS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def lift(stats: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Rows of features: a constant, the standardised statistics, and the cosines."""
    z = np.clip((stats - mean) / sd, -6, 6)
    w, b = waves()
    return np.hstack([np.ones((len(z), 1)), z, np.cos(z @ w + b) * math.sqrt(2 / FEATURES) * 4])


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = lift(stats, self.mean, self.sd) @ self.weights if len(self.weights) else np.zeros(len(stats))
        return np.clip(np.interp(raw, self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over sorted ``x`` with ``total`` rows and ``good`` positives: block centres and shares."""
    blocks: list[list[float]] = []
    for a, t, g in zip(x.tolist(), total.tolist(), good.tolist(), strict=True):
        blocks.append([a * t, t, g])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    knots = np.array([b[0] / b[1] for b in blocks])
    # Shares drawn slightly to the middle, so that a pure block at either end is no certainty.
    return knots, np.array([(b[2] + 0.02) / (b[1] + 0.04) for b in blocks])


def _statistics_of():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            stats = [statistics(t) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "h"), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "h", "stats"])

    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(column(batch, "stats").flatten()).reshape(batch.num_rows, N_STATS)


def _summed(rows: DataFrame, size: int, add) -> np.ndarray:
    """Sums of ``add(batch) -> (FOLDS, size)`` over all rows: a partial vector a task, then one aggregation in Spark.

    The vectors are cut into cells of 4096 numbers, so the aggregation is spread and what reaches the
    driver depends on the number of features only.
    """
    cell = 4096

    def run(batches):
        acc = np.zeros((FOLDS, size))
        for b in batches:
            if b.num_rows:
                acc += add(b)
        flat = acc.ravel()
        cells = range(0, len(flat), cell)
        yield pa.RecordBatch.from_arrays([pa.array([i // cell for i in cells], pa.int32()), pa.array([flat[i : i + cell] for i in cells], pa.list_(pa.float64()))], ["cell", "part"])

    def total(t: pa.Table) -> pa.Table:
        parts = t.column("part").combine_chunks()
        summed = np.asarray(parts.flatten()).reshape(t.num_rows, -1).sum(0)
        return pa.table({"cell": t.column("cell").slice(0, 1), "part": pa.array([summed], pa.list_(pa.float64()))})

    schema = "cell int, part array<double>"
    parts = rows.mapInArrow(run, schema).groupBy("cell").applyInArrow(total, schema).collect()
    out = np.zeros(FOLDS * size)
    for r in parts:
        out[r["cell"] * cell : r["cell"] * cell + len(r["part"])] = r["part"]
    return out.reshape(FOLDS, size)


def fit(documents: DataFrame, labels: DataFrame, keep: Column) -> Model:
    """A model of ``labels.quality`` over all labelled rows for which ``keep``, a condition on ``doc_id``, holds."""
    y = labelled(labels, "quality", keep).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")).withColumn("doc_id", F.col("doc_id").cast("long"))
    # Texts stay where they are: statistics are made before labels are joined.
    texts = documents.select("doc_id", "text").filter(keep & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    rows = texts.mapInArrow(_statistics_of(), "doc_id long, h long, stats array<double>")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("h", "stats")).alias("r"))
    rows = checkpointed(one.join(y, "doc_id").select("label", "fold", "r.stats"))
    rows = rows.coalesce(max(TASKS, rows.count() // TASK_ROWS))

    def moments(b):
        s, y = _matrix(b), np.asarray(column(b, "label"))
        out = np.zeros((FOLDS, 2 * N_STATS + 2))
        out[0] = np.concatenate([s.sum(0), np.square(s).sum(0), [len(s), y.sum()]])
        return out

    m = _summed(rows, 2 * N_STATS + 2, moments).sum(0)
    n, good = m[-2], m[-1]
    if n < 2 or good in (0, n):
        share = good / n if n else 0.5
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(0), np.array([0.0]), np.array([share]))
    mean = m[:N_STATS] / n
    sd = np.sqrt(np.maximum(m[N_STATS : 2 * N_STATS] / n - mean**2, 0))
    sd = np.where(sd > 1e-9, sd, 1.0)
    d = 1 + N_STATS + FEATURES

    def equations(b):
        phi, y, fold = lift(_matrix(b), mean, sd), np.asarray(column(b, "label")).astype(float), np.asarray(column(b, "fold"))
        out = np.zeros((FOLDS, d * d + d))
        for k in range(FOLDS):
            at = fold == k
            if at.any():
                out[k] = np.concatenate([(phi[at].T @ phi[at]).ravel(), phi[at].T @ y[at]])
        return out

    sums = _summed(rows, d * d + d, equations)

    def solve(s: np.ndarray) -> np.ndarray:
        ridge = RIDGE * np.eye(d)
        ridge[0, 0] = 1e-6
        return np.linalg.solve(s[: d * d].reshape(d, d) + ridge, s[d * d :])

    whole = solve(sums.sum(0))
    without = [solve(sums.sum(0) - sums[k]) for k in range(FOLDS)]

    # The scores by models that have not seen the row, counted in cells of fixed width: bounded at any size.
    low, step, cells = -1.0, 1 / 512, 1536

    def tally(b):
        phi, y, fold = lift(_matrix(b), mean, sd), np.asarray(column(b, "label")).astype(float), np.asarray(column(b, "fold"))
        raw = np.einsum("ij,ij->i", phi, np.stack(without)[fold])
        at = np.clip((raw - low) / step, 0, cells - 1).astype(int)
        out = np.zeros((FOLDS, 3 * cells))
        out[0] = np.concatenate([np.bincount(at, minlength=cells), np.bincount(at, y, minlength=cells), np.bincount(at, raw, minlength=cells)])
        return out

    t = _summed(rows, 3 * cells, tally).sum(0).reshape(3, cells)
    has = t[0] > 0
    knots, values = isotonic(np.sort(t[2][has] / t[0][has]), t[0][has], t[1][has])
    return Model(mean, sd, whole, knots, values)


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, "text"):
            s = shared.value.score(np.array([statistics(t) for t in column(b, "text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents``, all columns, whose score reaches ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, "text"):
            s = shared.value.score(np.array([statistics(t) for t in column(b, "text").to_pylist()]))
            yield b.filter(pa.array(s >= threshold))

    return documents.mapInArrow(run, documents.schema)


def training_row(mod: int, held: int) -> Column:
    """Whether crc32 of the id as text leaves another remainder than the held-out one."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod)) != held


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality; see the module for the method."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(documents, labels, training_row(5, 0))
    return score_documents(documents, model).select("doc_id", F.coalesce(~training_row(5, 0), F.lit(False)).alias("held_out"), "score", "predicted")
