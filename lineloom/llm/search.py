"""Nearest neighbours by score-aware (anisotropic) product quantisation, four-bit tables and exact reranking.

The nearest row by Euclidean distance is the one of largest inner product ``q.x - |x|^2 / 2``, so
rows get that norm as one more coordinate.  Codebooks of 16 words for each pair of coordinates are
fitted on a bounded sample under a loss that weighs the residual parallel to a row more than the
rest; every row is encoded once, by coordinate descent under the same loss, and its codes are written
beside it in the shared folder.  A query scans the codes by tables of 8-bit scores, two codes a
lookup, and the RERANK best rows of each block of rows are compared exactly, in double precision, on
the original vectors.

Queries are the stated set, in blocks of bounded size.  The driver holds one block at a time: it is
broadcast, scanned, its result written, and dropped, so neither memory nor plan grows with the
queries.  A task passes on as many rows a query as are asked for.  Vectors that are null, empty, zero,
of another length than most, or that hold null or non-finite components take no part, nor do rows
without an id.  Of rows with a query's id none is its candidate; several query rows of one id count as
one (the smallest vector).  Equal scores go to the smaller id, however many equal vectors there are.
An empty table gives no rows; further columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, hash_sample, store, stored

#: Bound on the rows that fit the codebooks.
FIT_ROWS = 8192
WORDS = 16
WIDTH = 2
#: Rows that share a scan, and how many of them a query compares exactly.
BLOCK = 8192
RERANK = 192
#: Queries sent out at a time.
QUERY_BLOCK = 4096
#: Inner products below this share of the norms do not matter to the loss.
MATTERS = 0.2
SCHEMA = "query_id long, rank int, vec_id long, score double"


def augmented(x: np.ndarray) -> np.ndarray:
    """Rows with half their squared norm as a last coordinate, padded to whole subspaces."""
    out = np.hstack([x, 0.5 * np.square(x).sum(1, keepdims=True)])
    return np.pad(out, ((0, 0), (0, -out.shape[1] % (2 * WIDTH))))


class Codebooks:
    def __init__(self, sample: np.ndarray, rounds: int = 4, seed: int = 7):
        x = augmented(sample)
        self.parts = x.shape[1] // WIDTH
        d = x.shape[1]
        self.eta = max(1.0, (d - 1) * MATTERS**2 / (1 - MATTERS**2))
        rng = np.random.default_rng(seed)
        self.words = np.zeros((self.parts, WORDS, WIDTH))
        for m in range(self.parts):
            part = x[:, m * WIDTH : (m + 1) * WIDTH]
            c = part[rng.integers(len(part), size=WORDS)] + 1e-9 * rng.standard_normal((WORDS, WIDTH))
            for _ in range(10):
                near = np.square(part[:, None] - c).sum(2).argmin(1)
                n = np.bincount(near, minlength=WORDS)
                for k in range(WIDTH):
                    c[:, k] = np.where(n > 0, np.bincount(near, part[:, k], minlength=WORDS) / np.maximum(n, 1), c[:, k])
            self.words[m] = c
        for _ in range(rounds):
            self._refit(x, self._assign(x))

    def _assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that lower ``|r|^2 + (eta - 1) (r.u)^2`` subspace by subspace; ``u`` is the row's direction."""
        n = len(x)
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        codes = np.zeros((n, self.parts), np.uint8)
        along = np.zeros((n, self.parts))
        cost, slope = [], []
        for m in range(self.parts):
            cut = slice(m * WIDTH, (m + 1) * WIDTH)
            r = x[:, None, cut] - self.words[m]
            cost.append(np.square(r).sum(2))
            slope.append((r * u[:, None, cut]).sum(2))
            codes[:, m] = cost[m].argmin(1)
            along[:, m] = slope[m][np.arange(n), codes[:, m]]
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = total - along[:, m]
                codes[:, m] = (cost[m] + (self.eta - 1) * np.square(rest[:, None] + slope[m])).argmin(1)
                along[:, m] = slope[m][np.arange(n), codes[:, m]]
                total = rest + along[:, m]
        return codes

    def _refit(self, x: np.ndarray, codes: np.ndarray, steps: int = 40) -> None:
        """All codewords at once: the least-squares solution of the loss for fixed codes, by conjugate gradients.

        The system is applied row by row and never formed, so it takes a few numbers a codeword.
        """
        size = self.parts * WORDS * WIDTH
        base = (np.arange(self.parts) * WORDS * WIDTH)[None, :, None] + np.arange(WIDTH)
        where = (base + codes[:, :, None].astype(np.int64) * WIDTH).reshape(len(x), -1)
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        n = np.bincount(where.ravel(), minlength=size) + 1e-6
        w = self.words.ravel().copy()

        def applied(v: np.ndarray) -> np.ndarray:
            along = (u * v[where]).sum(1, keepdims=True)
            return (self.eta - 1) * np.bincount(where.ravel(), (u * along).ravel(), minlength=size) + n * v

        r = self.eta * np.bincount(where.ravel(), x.ravel(), minlength=size) + 1e-6 * w - applied(w)
        z = r / n
        p, rz = z.copy(), float(r @ z)
        goal = 1e-12 * max(rz, 1e-30)
        for _ in range(steps):
            if rz <= goal:
                break
            ap = applied(p)
            alpha = rz / float(p @ ap)
            w, r = w + alpha * p, r - alpha * ap
            z = r / n
            rz, last = float(r @ z), rz
            p = z + rz / last * p
        self.words = w.reshape(self.words.shape)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of rows, two to a byte."""
        codes = np.concatenate([self._assign(augmented(x[i : i + 2048])) for i in range(0, len(x), 2048)])
        return np.ascontiguousarray(codes[:, 0::2] << 4 | codes[:, 1::2])

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of each query, the summed 8-bit scores of both codes of a byte: (queries, bytes, 256)."""
        full = np.zeros((len(q), self.parts * WIDTH))
        full[:, : q.shape[1]], full[:, q.shape[1]] = q, -1.0
        raw = np.einsum("qmw,mkw->qmk", full.reshape(len(q), self.parts, WIDTH), self.words)
        low = raw.min(2, keepdims=True)
        step = np.maximum((raw - low).max((1, 2), keepdims=True), 1e-30) / 255
        small = np.rint((raw - low) / step).astype(np.uint16)
        return (small[:, 0::2, :, None] + small[:, 1::2, None, :]).reshape(len(q), self.parts // 2, 256)


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, d))[:k]
    return d[order], ids[order]


def search_block(books: Codebooks, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, rerank: int):
    """Of each query, the ``k`` nearest found among one block of rows."""
    order = np.argsort(ids, kind="stable")
    ids, x, lines = ids[order], x[order], np.ascontiguousarray(codes[order].T)
    place = np.arange(len(x))
    last = min(rerank, len(x) - 1)
    for at in range(0, len(q), 256):
        tables = books.tables(q[at : at + 256])
        for j in range(at, min(at + 256, len(q))):
            score = np.zeros(len(x), np.int64)
            for line, table in zip(lines, tables[j - at], strict=True):
                score += table[line]
            near = np.argpartition(place - (score << 32), last)[: last + 1]
            near = near[ids[near] != qids[j]]
            yield _best(np.sqrt(np.square(x[near] - q[j]).sum(1)), ids[near], k)


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(column(batch, "embedding").flatten(), np.float64)
    return np.asarray(column(batch, "vec_id")), x.reshape(batch.num_rows, -1)


def coded(rows: DataFrame, books) -> DataFrame:
    """``(vec_id, embedding, code)`` of ``rows``, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = books.value.encode(_vectors(b)[1])
                yield pa.RecordBatch.from_arrays([column(b, "vec_id"), column(b, "embedding"), pa.array([c.tobytes() for c in codes], pa.binary())], ["vec_id", "embedding", "code"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"vec_id long, embedding {kind}, code binary"))


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the rows that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda v: v != 0))
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("embedding") == (size["d"] if size else 0))


def scanned(rows: DataFrame, books, queries: list[tuple[int, list[float]]], k: int, rerank: int) -> str:
    """Where the ``k`` nearest found among ``rows`` for one block of queries were written."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in queries]), np.array([v for _, v in queries], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] | None = None

        def add(held, best):
            ids, x, codes = (np.concatenate([h[i] for h in held]) for i in range(3))
            new = search_block(books.value, ids, x, codes, qids, q, k, rerank)
            if best is None:
                return list(new)
            return [_best(np.concatenate([a[0], c[0]]), np.concatenate([a[1], c[1]]), k) for a, c in zip(best, new, strict=True)]

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if size and size + part.num_rows > BLOCK:
                    best, held, size = add(held, best), [], 0
                codes = np.frombuffer(b"".join(column(part, "code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                held.append((*_vectors(part), codes))
                size += part.num_rows
        if size:
            best = add(held, best)
        if best is not None:
            many = [len(d) for d, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, many)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([d for d, _ in best]))], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    path = store(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    shared.destroy()
    return path


def nearest(embeddings: DataFrame, query_filter, k: int = 10, rerank: int = RERANK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each row for which ``query_filter`` holds."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    n = embeddings.count()
    sample = hash_sample(rows, "vec_id", FIT_ROWS, "codebooks", n).select("embedding").collect()
    if not sample:
        return spark.createDataFrame([], SCHEMA)
    books = spark.sparkContext.broadcast(Codebooks(np.array([r[0] for r in sample], np.float64)))
    rows = coded(rows.coalesce(max(1, -(-n // BLOCK))), books)
    queries = rows.filter(query_filter).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-rows.filter(query_filter).count() // query_block))
    paths = []
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(F.lit("query"), "vec_id"), F.lit(blocks)) == b)
        got = sorted((r["vec_id"], r["embedding"]) for r in mine.collect())
        if got:
            paths.append(scanned(rows, books, got, k, rerank))
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def op6_search(spark, sf_dir: str) -> DataFrame:
    """The ten nearest rows found for each row whose id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
