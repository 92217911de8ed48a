"""Near-duplicates by SimHash: byte-position index, count filter, verification, connected components.

Fingerprints that differ in at most ``d`` bits differ in at most ``d`` of their 8 bytes, so a linked
pair shares at least ``8 - d`` positional bytes.  The index posts every distinct fingerprint under
the values of ``7 - d`` byte positions, for a few choices of positions such that whichever ``d``
bytes of a pair differ, one choice holds none of them (11 choices of 5 bytes for two bits).  Pairs
that meet in a list share the bytes of its choice; their shared positional bytes are tallied over all
8 positions, pairs that reach the guaranteed minimum of ``8 - d`` are retained and verified bit by
bit.  Single positional bytes as keys would give the same pairs, but lists of one in 256 of all
fingerprints, which is quadratic work.

A list spans ``256 ** (d + 1)`` values at most, whatever the data.  Where many fingerprints meet, the
index goes on within the list: a pair differs in at most ``d`` pieces, so it shares one of any
``d + 1``, first of the bytes that the choice leaves, then of their halves, until lists are short.  All
pairs are decided by the same tally.  Of its links a list passes on a spanning forest, so what leaves
it is shorter than the list.

Equal fingerprints are one entry from the start; copies are never paired.  Null and empty texts have
fingerprint zero and link like any other.  Very long texts count whole.  Repeated ids are one document
as far as components go; each row is returned.  Null ids come last when a component's smallest id is
sought.  An empty table gives no rows; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, fresh, slices

SHINGLE = 3
BITS = 2
SEED = 42
#: Fingerprints of a list whose pairs are tallied without a further index.
SHORT = 128
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The hashes of a whole text's shingles, in their order; of fewer words, of all of them."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.array([], np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of ``hashes``."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        counts += np.unpackbits(hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64 bits of one whole text."""
    return majority(shingle_hashes(text, width))


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in column(b, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def choices(bits: int) -> list[tuple[int, ...]]:
    """Byte positions left out by each choice: sets of ``bits + 1``, so that any ``bits`` positions lie in one of them."""
    need, out = set(itertools.combinations(range(8), bits)), []
    while need:
        best = max(itertools.combinations(range(8), bits + 1), key=lambda c: len(need & set(itertools.combinations(c, bits))))
        need -= set(itertools.combinations(best, bits))
        out.append(best)
    return out


def halves(piece: int) -> list[int]:
    """The bits of a mask in two masks, or one if it has a single bit."""
    places = [k for k in range(64) if piece >> k & 1]
    cut = len(places) // 2
    return [sum(1 << k for k in part) for part in (places[:cut], places[cut:]) if part]


def short_lists(u: np.ndarray, at: np.ndarray, pieces: Sequence[int], bits: int) -> Iterator[np.ndarray]:
    """Parts of ``at`` (places in ``u``) such that each pair that differs in at most ``bits`` of ``pieces`` meets in one."""
    if len(at) <= SHORT:
        yield at
        return
    if len(pieces) <= bits:
        finer = [h for p in pieces for h in halves(p)]
        if len(finer) == len(pieces):
            yield at
            return
        yield from short_lists(u, at, finer, bits)
        return
    for k in range(bits + 1):
        value = u[at] & np.uint64(pieces[k])
        order = np.argsort(value, kind="stable")
        cuts = np.nonzero(np.diff(value[order]))[0] + 1
        for part in np.split(at[order], cuts):
            if len(part) > 1:
                yield from short_lists(u, part, [p for i, p in enumerate(pieces) if i != k], bits)


@lru_cache(maxsize=SHORT + 1)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def tallied(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``u`` that share at least ``8 - bits`` positional bytes and differ in at most ``bits`` bits."""
    i, j = _pairs(len(u)) if len(u) <= SHORT else np.triu_indices(len(u), 1)
    x = u[i] ^ u[j]
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = np.nonzero(shared >= 8 - bits)[0]
    near = near[np.bitwise_count(x[near]) <= bits]
    return i[near], j[near]


def list_links(fps: np.ndarray, bits: int, left_out: Sequence[int]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within one posting list: distinct fingerprints that share all bytes but ``left_out``."""
    u = fps.view(np.uint64)
    up = list(range(len(u)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for at in short_lists(u, np.arange(len(u)), [255 << 8 * p for p in left_out], bits):
        i, j = tallied(u[at], bits)
        for a, b in zip(at[i].tolist(), at[j].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
                yield int(fps[a]), int(fps[b])


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints of column ``fp``, enough to join all that are ``bits`` apart or less."""
    if not 0 < bits < 4:
        raise ValueError("one to three bits")
    left_out = choices(bits)
    masks = [(1 << 64) - 1 - sum(255 << 8 * p for p in c) for c in left_out]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(fps: np.ndarray, choice: int) -> None:
            for x, y in list_links(np.unique(fps), bits, left_out[choice]):
                out_a.append(x)
                out_b.append(y)

        held, key, out_a, out_b = [], None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            choice, byte, fp = (np.asarray(column(batch, c)) for c in ("choice", "bytes", "fp"))
            cuts = np.nonzero((choice[1:] != choice[:-1]) | (byte[1:] != byte[:-1]))[0] + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            if key == (choice[0], byte[0]):
                held.append(fp[: bounds[1]].copy())
                bounds = bounds[1:]
            if len(bounds) > 1:
                if held and sum(map(len, held)) > 1:
                    flush(np.concatenate(held), key[0])
                # Lists of one fingerprint, nearly all of them, need no look.
                for k in np.nonzero(np.diff(bounds[:-1]) > 1)[0]:
                    flush(fp[bounds[k] : bounds[k + 1]], choice[bounds[k]])
                held, key = [fp[bounds[-2] :].copy()], (choice[-1], byte[-1])
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        if held and sum(map(len, held)) > 1:
            flush(np.concatenate(held), key[0])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return postings.repartition("choice", "bytes").sortWithinPartitions("choice", "bytes").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``: ``root`` is the smallest node reachable.

    Alternating large-star and small-star steps, until a round changes nothing: every round before brings
    some node nearer to its root, so it ends.  Each round's edges are cut off in the shared folder.
    """
    now = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        # large star: every larger neighbour of u is tied to u's smallest.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        nxt = down.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = checkpointed(nxt)
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = seen


def classes(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct fingerprint of ``fps(doc_id, fp)``.

    ``root`` names the component, ``component_id`` is its smallest document.
    """
    first = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(first.select("fp"), bits))
    linked = roots.join(first, roots["node"] == first["fp"]).select("node", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "root", "least")
    return first.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))


def near_duplicates(documents: DataFrame, bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``documents``."""
    fps = checkpointed(fingerprints(documents, width))
    # Cut off, so that both sides of the join are plain exchanges and Spark can split a hot fingerprint.
    return fps.join(checkpointed(classes(fps, bits)), "fp").select("doc_id", "fp", "component_id")


def keyed_by_text(documents: DataFrame) -> tuple[DataFrame, str]:
    """``documents`` with a hash of the text in a further column, and its name."""
    name = fresh(documents, "__h")
    return documents.withColumn(name, F.xxhash64(F.coalesce("text", F.lit("")))), name


def one_of_each(documents: DataFrame, bits: int = BITS, width: int = SHINGLE) -> DataFrame:
    """``documents``, all columns, with one row of each component: the smallest id, then the smallest hash of the text.

    The chosen rows are found by id and hash again, so texts move once.
    """
    schema = documents.columns
    keyed, name = keyed_by_text(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in column(b, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "h"), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    rows = checkpointed(keyed.select(F.col("doc_id").cast("long"), "text", F.col(name).alias("h")).mapInArrow(run, "doc_id long, h long, fp long"))
    return kept_rows(keyed, name, rows.join(checkpointed(classes(rows, bits)), "fp").select("doc_id", "h", "root")).select(*schema)


def kept_rows(keyed: DataFrame, name: str, placed: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (with ``doc_id`` and a hash ``name``) that are first of their root in ``placed(doc_id, h, root)``."""
    chosen = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.h").alias("__first"))
    out = keyed.join(chosen, keyed["doc_id"].eqNullSafe(chosen["__id"]) & (keyed[name] == chosen["__first"]), "left_semi")
    if not placed.groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", name])
    return out


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id it is linked with."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
