"""Benchmark decontamination by Wu-Manber multi-pattern search over whole texts.

Texts are lower-cased (A-Z), cut into words and joined by single spaces; a pattern is a window of
benchmark words with a space at either end, so pattern occurrences are word-exact.  Patterns are
searched in classes of similar length.  For each class a shift table over hashed blocks tells how
far the search may jump, a bucket of suffix hashes names the patterns that may end where it may not
jump, and a direct comparison confirms.  The text of a slice is searched in many lanes at a time,
each with a position of its own.

The benchmark is the stated query set, taken in blocks of bounded size.  The driver holds one block
at a time: for each but the last, the texts with hits are found and written to the shared folder,
under two hashes of the text; the last block's pass carries the rows and is joined with what the
others found.  So the plan does not grow with the benchmark, and texts are never moved.

Null or empty texts have no words, and of very long ones every word counts.  A benchmark item without
words or without an id is no pattern.  Repeated item ids count once, repeated document ids are separate
rows.  Without documents there are no rows, without items no hits.  Further columns, whatever their
names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .common import column, fresh, slices, stored

WINDOW = 8
MIN_ITEMS = 2
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 16 << 20
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words of a whole text, as UTF-8."""
    return (text or "").encode().translate(_WORD).split()


class _Class:
    """Tables for patterns whose lengths lie within a factor of two."""

    def __init__(self, patterns: Sequence[bytes], ids: np.ndarray):
        self.m = m = min(map(len, patterns))
        self.kind = np.dtype("<u8" if m >= 8 else "<u4" if m >= 4 else "<u2")
        self.block = b = self.kind.itemsize
        self.ids, self.patterns = ids, patterns
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        blocks = np.stack([np.ascontiguousarray(heads[:, j : j + b]).view(self.kind).ravel() for j in range(m - b + 1)])
        self.bits = np.uint64(64 - min(22, max(12, int(blocks.size * 4).bit_length())))
        size = 1 << (64 - int(self.bits))
        self.shift = np.full(size, m - b + 1, np.int32)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, self.hash(blocks[j]), m - b - j)
        suffix = self.hash(blocks[m - b])
        order = np.argsort(suffix, kind="stable")
        self.bucket = order
        self.start = np.searchsorted(suffix[order], np.arange(size + 1))
        self.prefix = blocks[0]

    def hash(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.uint64) * _MULT >> self.bits).astype(np.int64)

    def find(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start offsets and pattern ids of all occurrences in ``buf``."""
        n, m, b = len(buf), self.m, self.block
        last = n - m + 1
        if last <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.ndarray((n - b + 1,), self.kind, buffer=buf, strides=(1,))
        span = max(256, -(-last // 16384))
        p = np.arange(0, last, span, dtype=np.int64)
        end = np.minimum(p + span, last)
        spots, hashes = [], []
        while len(p):
            h = self.hash(at[p + (m - b)])
            jump = self.shift[h]
            stop = jump == 0
            if stop.any():
                spots.append(p[stop])
                hashes.append(h[stop])
            p = p + np.maximum(jump, 1)
            on = p < end
            p, end = p[on], end[on]
        if not spots:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spot, h = np.concatenate(spots), np.concatenate(hashes)
        many = self.start[h + 1] - self.start[h]
        spot = np.repeat(spot, many)
        inside = np.arange(len(spot)) - np.repeat(np.cumsum(many) - many, many)
        which = self.bucket[np.repeat(self.start[h], many) + inside]
        same = at[spot] == self.prefix[which]
        spot, which = spot[same], which[same]
        pats = self.patterns
        sure = np.fromiter((buf.startswith(pats[w], s) for s, w in zip(spot.tolist(), which.tolist(), strict=True)), bool, len(spot))
        return spot[sure], self.ids[which[sure]]


class Matcher:
    """The windows of a block of benchmark items, ready to be searched."""

    def __init__(self, items: Sequence[tuple[str, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, int], set[str]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i : i + window]
                owners.setdefault((b" " + b" ".join(part) + b" ", len(part)), set()).add(item)
        self.owners = list(owners.values())
        self.n_words = np.array([k[1] for k in owners], np.int64)
        by: dict[int, list[int]] = {}
        for i, (p, _) in enumerate(owners):
            by.setdefault(min(6, len(p).bit_length()), []).append(i)
        texts = [k[0] for k in owners]
        self.classes = [_Class([texts[i] for i in ids], np.array(ids)) for ids in by.values()]

    def search(self, texts: Sequence[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """Of each text: its number of words, its hit words as booleans, and the items with occurrences."""
        words = [words_of(t) for t in texts]
        parts = [b" " + b" ".join(w) + b" \n" for w in words]
        buf = b"".join(parts)
        begin = np.cumsum([0] + [len(p) for p in parts])
        found = [c.find(buf) for c in self.classes]
        spot = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        which = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        items: dict[int, set[str]] = {}
        hits: dict[int, np.ndarray] = {}
        if len(spot):
            doc = np.searchsorted(begin, spot, "right") - 1
            order = np.argsort(doc, kind="stable")
            doc, spot, which = doc[order], spot[order], which[order]
            cuts = np.concatenate([[0], np.nonzero(doc[1:] != doc[:-1])[0] + 1, [len(doc)]])
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                d = int(doc[a])
                spaces = np.nonzero(np.frombuffer(parts[d], np.uint8) == 32)[0]
                first = np.searchsorted(spaces, spot[a:z] - begin[d])
                marks = np.zeros(len(words[d]) + 1, np.int64)
                np.add.at(marks, first, 1)
                np.add.at(marks, first + self.n_words[which[a:z]], -1)
                hits[d] = np.cumsum(marks)[:-1] > 0
                items[d] = set().union(*(self.owners[w] for w in set(which[a:z].tolist())))
        return [(len(w), hits.get(i, np.zeros(len(w), bool)), items.get(i, set())) for i, w in enumerate(words)]


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[str, str | None], ...], window: int) -> Matcher:
    return Matcher(items, window)


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[tuple[tuple[str, str], ...]]:
    """The benchmark's items in blocks of about ``limit`` bytes of text."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.col("item").isNotNull() & F.col("text").isNotNull())
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield tuple(sorted(tuple(r) for r in part.distinct().collect()))


def merged(x: bytes, y: bytes) -> bytes:
    """The union of two sets of packed bits; an empty one is shorter."""
    if not x or not y:
        return x or y
    return np.bitwise_or(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).tobytes()


FOUND = StructType().add("n_words", "long").add("hits", "binary").add("n_hit", "long").add("items", ArrayType(StringType()))
#: What an earlier block found in a text.
PART = "h1 long, h2 long, hits binary, items array<string>"


def _searched(b: pa.RecordBatch, matcher: Matcher) -> tuple[list[int], list[bytes], list[set[str]]]:
    found = matcher.search(column(b, "text").to_pylist())
    return [n for n, _, _ in found], [np.packbits(h).tobytes() if i else b"" for _, h, i in found], [i for _, _, i in found]


def _found(n_words: Sequence[int], bits: Sequence[bytes], items: Sequence[set[str]]) -> pa.Array:
    columns = [pa.array(n_words, pa.int64()), pa.array(bits, pa.binary()), pa.array([int.from_bytes(x, "big").bit_count() for x in bits], pa.int64()), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
    return pa.StructArray.from_arrays(columns, FOUND.names)


def earlier(documents: DataFrame, block, window: int) -> DataFrame:
    """What ``block`` finds in the texts of ``documents``: rows of PART, stored, of texts with hits only."""
    shared = documents.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value, window)
        for b in slices(batches, "text"):
            _, bits, items = _searched(b, matcher)
            hit = [k for k, i in enumerate(items) if i]
            if hit:
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays([column(b, "h1").take(at), column(b, "h2").take(at), pa.array([bits[k] for k in hit], pa.binary()), pa.array([sorted(items[k]) for k in hit], pa.list_(pa.string()))], ["h1", "h2", "hits", "items"])

    keyed = documents.filter("text is not null").select("text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("again"), "text").alias("h2"))
    # Copies of a text give equal rows.
    out = stored(keyed.mapInArrow(run, PART).groupBy("h1", "h2").agg(F.first("hits").alias("hits"), F.first("items").alias("items")))
    shared.destroy()
    return out


def scan(documents: DataFrame, benchmark: DataFrame, carry: Sequence[str], window: int = WINDOW, limit: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``carry`` of ``documents`` and, last, a struct of FOUND.

    It holds the number of words, the hit words as packed bits (empty if none), their number, and the
    items found, sorted.  Its column is called ``found``, with underscores if that is taken.
    """
    before, block = [], None
    for following in blocks_of(benchmark, limit):
        if block is not None:
            before.append(earlier(documents.select("text"), block, window))
        block = following
    shared = documents.sparkSession.sparkContext.broadcast(block)
    name = fresh(documents, "found")
    text = F.col("text")
    kept = [n for n in documents.columns if n in set(carry)]
    rows = documents.select(*kept, *([] if "text" in kept else ["text"]))
    h1, h2 = fresh(rows, "__h1"), fresh(rows, "__h2")
    if before:
        rows = rows.withColumn(h1, F.xxhash64(text)).withColumn(h2, F.xxhash64(F.lit("again"), text))
    names = [n for n in rows.columns if n != "text" or "text" in kept]
    kind = StructType([rows.schema[n] for n in names]).add(name, FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value, window)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*[column(b, n) for n in names], _found(*_searched(b, matcher))], [*names, name])

    out = rows.mapInArrow(run, kind)
    if not before:
        return out.select(*carry, name)
    known = before[0]
    for k in before[1:]:
        known = known.unionByName(k)
    # One row a text, with as many parts as there are blocks at most.
    more = fresh(out, "__more")
    known = known.groupBy("h1", "h2").agg(F.collect_list(F.struct("hits", "items")).alias(more))
    out = out.join(known, (out[h1] == known["h1"]) & (out[h2] == known["h2"]), "left").select(*carry, name, more)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, bits, items = [], [], []
            for f, parts in zip(column(b, name).to_pylist(), column(b, more).to_pylist(), strict=True):
                x, found = f["hits"], set(f["items"])
                for p in parts or ():
                    x = merged(x, p["hits"])
                    found.update(p["items"])
                n_words.append(f["n_words"])
                bits.append(x)
                items.append(found)
            yield pa.RecordBatch.from_arrays([*[column(b, n) for n in carry], _found(n_words, bits, items)], [*carry, name])

    return out.mapInArrow(unite, StructType([out.schema[n] for n in carry]).add(name, FOUND))


def report(documents: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of every row."""
    found = scan(documents.select("doc_id", "text"), benchmark, ["doc_id"])
    n_items = F.size("found.items").cast("long")
    return found.select("doc_id", "found.n_words", "found.n_hit", n_items.alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents``, all columns, without any window of a benchmark item."""
    found = scan(documents, benchmark, documents.columns, window)
    return found.filter(F.size(F.col(found.columns[-1])["items"]) == 0).select(*documents.columns)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document's words, words hit by benchmark windows, and benchmark items found."""
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return report(documents.select(F.col("doc_id").cast("long"), "text"), benchmark)


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS_SQL}, []) AS ws FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS ws FROM benchmark),
  bw AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(2, len(ws) - {WINDOW - 2})), lambda i: array_to_string(ws[i:i + {WINDOW - 1}], ' '))) AS win FROM b WHERE len(ws) > 0),
  ns AS (SELECT DISTINCT n FROM bw),
  dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS win FROM d, ns WHERE len(ws) >= n),
  hit AS (SELECT doc_id, pos, n, item FROM dw JOIN bw USING (n, win)),
  marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id),
  items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)"""
