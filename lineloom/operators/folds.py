"""Operators whose next step depends on the last result: one document (or page) at a time, in Arrow batches.

A group is one document, not a key of the data at large; documents are spread over all tasks.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chords import GRAMMAR, count_brackets
from ..functions.similarity import lyric_similarity, near_duplicate
from ..functions.text import lyric_key, stripped
from .sequence import ordered, so_far

#: Comments that name a part of the structure, and what recognition takes for a chord.  Fixed values.
_STRUCTURE = re.compile(r"^\{comment:\s*(?:vers\s+\d+|chorus|bridge|coda|fine|d\.?c\.? al fine|d\.?s\.? al fine)\}\s*$", re.I)
_CHORD = re.compile(rf"^{GRAMMAR['loose']}$", re.I)
LINES = "doc_id long, line_no int, line string"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _starts(rows: pa.RecordBatch | pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """The rows, but the first, whose keys are not those of the row before."""
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys:
        c = rows.column(k)
        v = np.asarray(c) if c.null_count == 0 and pa.types.is_integer(c.type) else np.unique(np.array([repr(x) for x in c.to_pylist()]), return_inverse=True)[1]
        new |= v[1:] != v[:-1]
    return np.flatnonzero(new) + 1


def _fold(rows: DataFrame, step: Callable[[pa.Table, np.ndarray], dict], schema: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``step`` over whole documents of ``rows``, which lie together in order: ``(table, bounds) -> columns``.

    ``bounds`` holds where each document begins and, last, the end.  Many documents are folded in one
    call, so that the cost of a call is not that of a document.
    """
    types = [(n, _ARROW[t]) for n, t in (c.split() for c in schema.split(", "))]

    def folded(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        got = step(table, np.array([0, *_starts(table, keys), table.num_rows]))
        arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (got[n] for n, _ in types)]
        return pa.record_batch([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, t) in zip(arrays, types, strict=True)], names=[n for n, _ in types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            first, starts = [b.column(k)[0].as_py() for k in keys], _starts(b, keys)
            cut = starts[-1] if len(starts) else 0 if first != last else None
            if cut is None:
                held.append(b)
            else:
                whole = [*held, b.slice(0, cut)] if cut else held
                if whole:
                    yield folded(whole)
                held = [b.slice(cut)]
            last = [b.column(k)[-1].as_py() for k in keys]
        if held:
            yield folded(held)

    return rows.mapInArrow(run, schema)


def _by_key(df: DataFrame, *order: Column | str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of a document together and in order."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def _last(name: str) -> Column:
    """A number to sort by, missing ones at the end."""
    return F.when(~F.isnan(name), F.col(name)).asc_nulls_last()


def _fold_lines(rows: DataFrame, step: Callable[..., list[str]], *more: str) -> DataFrame:
    """``step`` over the lines of each document (and of the columns ``more``) to its new lines, which are numbered anew."""

    def run(table: pa.Table, bounds: np.ndarray) -> dict:
        lines = pc.fill_null(table.column("line"), "").to_pylist()
        other = [table.column(c).to_pylist() for c in more]
        out: list[str] = []
        n = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            new = step(lines[i:j], *[o[i:j] for o in other])
            n.append(len(new))
            out += new
        n = np.array(n)
        at = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        return {"doc_id": table.column("doc_id").take(pa.array(np.repeat(bounds[:-1], n))), "line_no": at, "line": out}

    return _fold(rows, run, LINES)


def _by_document(df: DataFrame, step: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``step`` over the rows of each document, streamed from sorted partitions: many small documents share a batch."""
    names = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            before = pd.concat([held[-1].iloc[-1:], pdf.iloc[:-1]])[names].reset_index(drop=True) if held else pdf[names].shift()
            now = pdf[names].reset_index(drop=True)
            same = ((now == before) | (now.isna() & before.isna())).all(axis=1).to_numpy(copy=True)
            if not held:
                same[0] = False
            starts = np.flatnonzero(~same)
            if not len(starts):
                held.append(pdf)
                continue
            if starts[0] > 0:
                held.append(pdf.iloc[: starts[0]])
            out = [step(pd.concat(held))] if held else []
            out += [step(pdf.iloc[i:j]) for i, j in zip(starts[:-1], starts[1:], strict=True)]
            if out:
                yield pd.concat(out)
            held = [pdf.iloc[starts[-1] :]]
        if held:
            yield step(pd.concat(held))

    return df.repartition(*names).sortWithinPartitions(*names).mapInPandas(run, schema)


def _is_directive(line: str) -> bool:
    return line.startswith("{") and line.endswith("}")


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance; the differences down a column are the bits of two integers (Myers, Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(b)) - 1
    more, less = every, 0
    for y in a:
        same = where.get(y, 0)
        across = (((same & more) + more) ^ more) | same | less
        up, down = less | (every & ~(across | more)), more & across
        up, down = up << 1 | 1, down << 1
        more, less = (down | ~(across | up)) & every, up & across & every
    return len(a) + more.bit_count() - less.bit_count()


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """Edit similarity; 0 where the letters that both hold rule out ``least``."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b))
    if least and (min(len(a), len(b)) < least * longer - 1e-9 or (Counter(a) & Counter(b)).total() < least * longer - 1e-9):
        return 0.0
    return 1 - edit_distance(a, b) / longer


def normal(text: str) -> str:
    low = re.sub(r"\[[^\]]+\]", "", text).lower().translate(str.maketrans("äöü", "aou")).replace("ß", "ss")
    return re.sub("[^a-z0-9]+", "", low)


def strip_marks(text: str) -> str:
    """Letters without any combining mark (all scripts, where the native table knows Latin only)."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"))


def drop_repeated_structure(df: DataFrame, most: int = 3) -> DataFrame:
    """A structure comment that repeats the last one kept after one to ``most`` lyric lines goes, with the blank lines before it.

    A dropped comment starts the count of lyric lines anew, as a kept one does.
    """

    def step(lines: list[str]) -> list[str]:
        keep, last, lyrics = [], None, 0
        for line in lines:
            s = line.strip()
            if _STRUCTURE.match(s):
                again, last = s.lower() == last and 1 <= lyrics <= most, s.lower()
                lyrics = 0
                if again:
                    while keep and not keep[-1].strip():
                        keep.pop()
                    continue
            elif s and not s.startswith("{"):
                lyrics += 1
            keep.append(line)
        return keep

    return _fold_lines(_by_key(df.select("doc_id", "line_no", "line"), "line_no"), step)


def collapse_near_repeats(df: DataFrame, least: int = 8, similar: float = 0.74, long: int = 1000) -> DataFrame:
    """Neighbouring lines that nearly repeat the line kept: the better one stays.

    Spark compares each line with the one before it; the fold compares only where another line is kept,
    and lines of more than ``long`` letters, for which its distances take less time.
    """

    def score(line: str) -> int:
        n, d = sum(map(str.isalpha, line)), sum(map(str.isdigit, line))
        weird = sum(not (c.isalnum() or c.isspace() or c in ".,;:!?'\"()-") for c in line)
        return 4 * n + len(line.split()) - 3 * d - 5 * weird

    def near(a: str, b: str) -> bool:
        return a == b or (min(len(a), len(b)) >= least and (a in b or b in a or similarity(a, b, similar) >= similar))

    def step(lines: list[str], repeats: list[bool | None]) -> list[str]:
        keep: list[str] = []
        kept = -1
        for i, line in enumerate(lines):
            s = line.strip()
            if keep and s and not _is_directive(s) and (repeats[i] if kept == i - 1 and repeats[i] is not None else near(normal(keep[-1]), normal(s))):
                if score(s) > score(keep[-1]):
                    keep[-1], kept = line, i
                continue
            keep.append(line)
            kept = i
        return keep

    rows = df.select("doc_id", "line_no", "line", lyric_key(F.col("line")).alias("__a")).repartition("doc_id")
    rows = rows.withColumn("__b", F.lag("__a").over(ordered()))
    again = F.when((F.length("__a") <= long) & (F.length("__b") <= long), near_duplicate(F.col("__a"), F.col("__b"), least, similar))
    return _fold_lines(rows.select("doc_id", "line_no", "line", again.alias("__again")).sortWithinPartitions("doc_id", "line_no"), step, "__again")


def join_fragments(df: DataFrame) -> DataFrame:
    """Lines joined to the line grown so far: two short ones, after a hyphen, before a small letter or a mark, or an open end.

    Blank lines and directives stay apart.
    """
    letter = re.compile("[A-Za-zÄÖÜäöüß]")

    def joins(first: str, last: str, size: int, b: str) -> bool:
        if not size or not b or (first == "{" and last == "}") or _is_directive(b):
            return False
        return (size < 24 and len(b) < 24) or last == "-" or b[0].islower() or b[0] in ",.:;" or (last not in ".!?" and letter.match(b) is not None and size < 60)

    def step(lines: list[str]) -> list[str]:
        out: list[str] = []
        # The parts of the line grown so far, and their length: a line is put together once.
        parts: list[str] = []
        size = 0
        for line in lines:
            s = line.strip()
            if parts and joins(next((x[0] for x in parts if x), ""), parts[-1][-1:], size, s):
                if parts[-1].endswith("-"):
                    parts[-1] = parts[-1][:-1]
                    size -= 1
                elif s[0] not in ",.;:!?":
                    parts.append(" ")
                    size += 1
                parts.append(s)
                size += len(s)
            else:
                if parts:
                    out.append("".join(parts))
                parts, size = [s], len(s)
        return [*out, "".join(parts)] if parts else out

    return _fold_lines(_by_key(df.select("doc_id", "line_no", "line"), "line_no"), step)


def cluster_lines(words: DataFrame, at: str = "bottom", tolerance: float = 2.0, grow: bool = True) -> DataFrame:
    """Words of a page as lines: a word joins the open line whose running mean of ``at`` is within ``tolerance``.

    Words come from the top (largest ``at`` first) and from the left; with ``grow`` off the first word's
    position stays the line's.
    """

    def step(table: pa.Table, bounds: np.ndarray) -> dict:
        places = _numbers(table, at).tolist()
        out = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            line, mean, n = -1, 0.0, 0
            for y in places[i:j]:
                if line < 0 or abs(y - mean) > tolerance:
                    line, mean, n = line + 1, y, 1
                elif grow:
                    mean, n = (mean * n + y) / (n + 1), n + 1
                out.append(line)
        return {c: table.column(c) for c in ("doc_id", "page_no", "word_no")} | {"line_no": out}

    down = F.when(~F.isnan(at), F.col(at)).desc_nulls_last()
    rows = _by_key(words.select("doc_id", "page_no", "word_no", "left", at), down, _last("left"), "word_no", keys=("doc_id", "page_no"))
    return _fold(rows, step, "doc_id long, page_no int, word_no int, line_no int", ("doc_id", "page_no"))


def bucket_regions(regions: DataFrame, least: float = 8.0, share: float = 0.62) -> DataFrame:
    """Regions of a page as lines: each joins the line whose centre is nearest, if within ``max(least, share * height)``."""

    def page(tops: list[float], bottoms: list[float]) -> list[int]:
        lines: list[tuple[float, int]] = []  # centres in order, each with its line
        heights: list[float] = []
        counts: list[int] = []
        out = []
        for top, bottom in zip(tops, bottoms, strict=True):
            c, h = (top + bottom) / 2, bottom - top
            at = bisect_left(lines, (c, -1))
            best = None
            # Outwards to either side, as far as centres are no further away than the nearest.
            k = at
            while k < len(lines) and (best is None or lines[k][0] - c <= best[0]):
                best = min(best, (lines[k][0] - c, lines[k][1], k)) if best else (lines[k][0] - c, lines[k][1], k)
                k += 1
            k = at - 1
            while k >= 0 and (best is None or c - lines[k][0] <= best[0]):
                best = min(best, (c - lines[k][0], lines[k][1], k)) if best else (c - lines[k][0], lines[k][1], k)
                k -= 1
            if best and best[0] <= max(least, share * max(h, heights[best[1]])):
                near, n = best[1], counts[best[1]]
                centre = (lines.pop(best[2])[0] * n + c) / (n + 1)
                heights[near], counts[near] = (heights[near] * n + h) / (n + 1), n + 1
                insort(lines, (centre, near))
            else:
                near = len(counts)
                lines.insert(at, (c, near))
                heights.append(h)
                counts.append(1)
            out.append(near)
        return out

    def step(table: pa.Table, bounds: np.ndarray) -> dict:
        tops, bottoms = _numbers(table, "top").tolist(), _numbers(table, "bottom").tolist()
        out: list[int] = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out += page(tops[i:j], bottoms[i:j])
        return {c: table.column(c) for c in ("doc_id", "page_no", "region_no")} | {"line_no": out}

    rows = _by_key(regions.select("doc_id", "page_no", "region_no", "top", "left", "bottom"), _last("top"), _last("left"), "region_no", keys=("doc_id", "page_no"))
    return _fold(rows, step, "doc_id long, page_no int, region_no int, line_no int", ("doc_id", "page_no"))


def merge_regions(regions: DataFrame) -> DataFrame:
    """Neighbouring regions of a line merged into the growing left one where they are parts of one word.

    Neither may be a chord; the gap is small for the line's height, letters meet (not two capitals), tops
    agree, and one part is short, nearly touches, or both letters are small.
    """

    def merges(a: list, b: list, mean: float) -> bool:
        left, right = a[4].strip(), b[4].strip()
        if not left or not right or _CHORD.match(left) or _CHORD.match(right):
            return False
        gap = b[0] - a[1]
        height = max(1.0, min(max(a[3] - a[2], b[3] - b[2]), mean))
        x, y = left[-1], right[0]
        if gap < -2 or gap > max(4.5, height * 0.42) or not (x.isalpha() and y.isalpha()) or (x.isupper() and y.isupper()):
            return False
        if abs(a[2] - b[2]) > max(4.0, height * 0.25):
            return False
        return len(left) <= 5 or len(right) <= 5 or gap <= 1.5 or (x.islower() and y.islower())

    def step(table: pa.Table, bounds: np.ndarray) -> dict:
        left, right, top, bottom = (_numbers(table, c).copy() for c in ("left", "right", "top", "bottom"))
        text = pc.fill_null(table.column("text"), "").to_pylist()
        n, high = np.diff(bounds), bottom - top
        line = np.repeat(np.arange(len(n)), n)
        known = ~np.isnan(high)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.add.reduceat(np.where(known, high, 0.0), bounds[:-1]) / np.add.reduceat(known.astype(float), bounds[:-1])
        # Regions that their place keeps apart from the one before them need no look at their text.
        gap = left[1:] - right[:-1]
        height = np.maximum(1.0, np.minimum(np.maximum(high[:-1], high[1:]), mean[line[1:]]))
        apart = (gap < -2) | (gap > np.maximum(4.5, height * 0.42)) | (np.abs(np.diff(top)) > np.maximum(4.0, height * 0.25))
        gone = np.zeros(len(text), bool)
        after = 0
        for i in (np.flatnonzero((line[1:] == line[:-1]) & ~apart) + 1).tolist():
            if i < after:
                continue
            a = [left[i - 1], right[i - 1], top[i - 1], bottom[i - 1], text[i - 1]]
            k, end = i, bounds[line[i] + 1]
            while k < end and merges(a, b := [left[k], right[k], top[k], bottom[k], text[k]], mean[line[i]]):
                a = [min(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), a[4].strip() + b[4].strip()]
                gone[k] = True
                k += 1
            if k > i:
                left[i - 1], right[i - 1], top[i - 1], bottom[i - 1], text[i - 1] = a
            after = k + 1
        stay = np.flatnonzero(~gone)
        kept = np.bincount(line[stay], minlength=len(n))
        out = {c: table.column(c).take(pa.array(stay)) for c in ("doc_id", "page_no", "line_no")}
        out |= {"region_no": np.arange(len(stay)) - np.repeat(np.cumsum(kept) - kept, kept), "text": [text[i] for i in stay]}
        return out | {"left": left[stay], "right": right[stay], "top": top[stay], "bottom": bottom[stay]}

    keys = ("doc_id", "page_no", "line_no")
    rows = regions.select(*keys, "region_no", *[F.col(c).cast("double").alias(c) for c in ("left", "right", "top", "bottom")], "text")
    rows = _by_key(rows, _last("left"), "region_no", keys=keys)
    return _fold(rows, step, "doc_id long, page_no int, line_no int, region_no int, left double, right double, top double, bottom double, text string", keys)


def same_region(p: tuple, q: tuple, least: float = 0.55) -> bool:
    """Whether two regions ``(left, right, top, bottom, text)`` are one, read twice.

    Their boxes overlap and one text holds the other, or the texts are equal and the centres close.
    """
    a, b = (re.sub("[^a-z0-9]+", "", (r[4] or "").lower()) for r in (p, q))
    if not a or not b:
        return False
    w, h = min(p[1], q[1]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[2], q[2])
    common = w * h if w > 0 and h > 0 else 0.0
    whole = (p[1] - p[0]) * (p[3] - p[2]) + (q[1] - q[0]) * (q[3] - q[2]) - common
    if whole > 0 and common / whole >= least and (a in b or b in a):
        return True
    down, across = abs(p[2] + p[3] - q[2] - q[3]) / 2, abs(p[0] + p[1] - q[0] - q[1]) / 2
    return a == b and down <= max(p[3] - p[2], q[3] - q[2]) * 0.35 and across <= max(p[1] - p[0], q[1] - q[0]) * 0.35


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False))


def _touching(p: tuple, q: tuple, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of boxes ``p`` and ``q``, arrays of ``(left, right, top, bottom)``: whether they overlap by ``least``, and whether centres are close."""
    w, h = np.minimum(p[1], q[1]) - np.maximum(p[0], q[0]), np.minimum(p[3], q[3]) - np.maximum(p[2], q[2])
    common = np.where((w > 0) & (h > 0), w * h, 0.0)
    whole = (p[1] - p[0]) * (p[3] - p[2]) + (q[1] - q[0]) * (q[3] - q[2]) - common
    with np.errstate(divide="ignore", invalid="ignore"):
        over = (whole > 0) & (common / whole >= least)
    down, across = np.abs(p[2] + p[3] - q[2] - q[3]) / 2, np.abs(p[0] + p[1] - q[0] - q[1]) / 2
    return over, (down <= np.maximum(p[3] - p[2], q[3] - q[2]) * 0.35) & (across <= np.maximum(p[1] - p[0], q[1] - q[0]) * 0.35)


def _bare(text: str | None) -> str:
    return re.sub("[^a-z0-9]+", "", (text or "").lower())


def _same_text(a: str, b: str, over: bool, close: bool) -> bool:
    return bool(a) and bool(b) and ((over and (a in b or b in a)) or (close and a == b))


def _near_pairs(box: tuple, bounds: np.ndarray, reach: np.ndarray, least: float, most: int) -> tuple[np.ndarray, ...]:
    """Pairs of rows of a page, in order of the later one, whose boxes may be of one region; pages of more than ``most`` rows are left out."""
    n = np.diff(bounds)
    page = np.repeat(np.arange(len(n)), n)
    found = []
    # All pairs count where no overlap is asked for.
    far = np.inf if least <= 0 else reach
    i = np.flatnonzero(np.repeat(n <= most, n))
    for k in range(1, most):
        i = i[i + k < bounds[-1]]
        i = i[(page[i + k] == page[i]) & (box[2][i + k] <= (far if least <= 0 else far[i]))]
        if not len(i):
            break
        over, close = _touching(tuple(x[i] for x in box), tuple(x[i + k] for x in box), least)
        hit = over | close
        found.append((i[hit], i[hit] + k, over[hit], close[hit]))
    if not found:
        return (np.array([], int),) * 2 + (np.array([], bool),) * 2
    a, b, over, close = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.lexsort((a, b))
    return a[by], b[by], over[by], close[by]


def _fold_pairs(pairs: tuple[np.ndarray, ...], text: pa.ChunkedArray, value: np.ndarray, gone: np.ndarray) -> None:
    """Sets ``gone`` for the rows that repeat one kept: a row only meets those that it has a pair with."""
    a, b, over, close = (x.tolist() for x in pairs)
    involved = np.unique(np.concatenate(pairs[:2]))
    bare = dict(zip(involved.tolist(), map(_bare, text.take(pa.array(involved)).to_pylist()), strict=True))
    place: dict[int, int] = {}
    k = 0
    while k < len(b):
        row, first = b[k], None
        while k < len(b) and b[k] == row:
            if not gone[a[k]] and _same_text(bare[a[k]], bare[row], over[k], close[k]):
                at = place.get(a[k], a[k])
                first = min(first, (at, a[k])) if first else (at, a[k])
            k += 1
        if first:
            if value[row] > value[first[1]]:
                gone[first[1]] = True
                place[row] = first[0]
            else:
                gone[row] = True


def _fold_page(box: tuple, text: pa.ChunkedArray, value: np.ndarray, reach: np.ndarray, least: float, gone: np.ndarray) -> None:
    """As :func:`_fold_pairs`, for one page of many rows: each meets the rows kept that reach down to it."""
    bare = list(map(_bare, text.to_pylist()))
    kept = np.array([], int)  # rows, in the order of their places
    for i in range(len(value)):
        if i % 256 == 0 and least > 0:
            kept = kept[~(reach[kept] < box[2][i])]
        over, close = _touching(tuple(x[kept] for x in box), tuple(x[i] for x in box), least)
        same = next((k for k in np.flatnonzero(over | close) if _same_text(bare[kept[k]], bare[i], over[k], close[k])), None)
        if same is None:
            kept = np.append(kept, i)
        elif value[i] > value[kept[same]]:
            gone[kept[same]] = True
            kept[same] = i
        else:
            gone[i] = True


def drop_duplicate_regions(regions: DataFrame, least: float = 0.55, most: int = 512) -> DataFrame:
    """Regions that repeat one kept before go (see :func:`same_region`); the better by score and length stays in its place.

    Pages are folded many at once, those of more than ``most`` regions each for itself.
    """

    def step(table: pa.Table, bounds: np.ndarray) -> dict:
        left, right, top, bottom = (_numbers(table, c) for c in ("left", "right", "top", "bottom"))
        value = _numbers(table, "score") + 0.01 * pc.utf8_length(pc.fill_null(table.column("text"), "")).to_numpy()
        text = table.column("text")
        box = (left, right, top, bottom)
        # A region can only be one that begins above its bottom (where a box is upside down, half its height further).
        height = bottom - top
        reach = np.maximum(top, bottom) + max(0.0, -np.nanmin(height, initial=0.0)) / 2
        gone = np.zeros(len(top), bool)
        _fold_pairs(_near_pairs(box, bounds, reach, least, most), text, value, gone)
        for i, j in zip(bounds[:-1], bounds[1:], strict=True):
            if j - i > most:
                _fold_page(tuple(x[i:j] for x in box), text.slice(i, j - i), value[i:j], reach[i:j], least, gone[i:j])
        return {c: table.column(c).filter(pa.array(~gone)) for c in ("doc_id", "page_no", "region_no")}

    rows = regions.select("doc_id", "page_no", "region_no", *[F.col(c).cast("double").alias(c) for c in ("left", "right", "top", "bottom", "score")], "text")
    rows = _by_key(rows, _last("top"), _last("left"), "region_no", keys=("doc_id", "page_no"))
    return _fold(rows, step, "doc_id long, page_no int, region_no int", ("doc_id", "page_no"))


def place_chords(target: str, donor: str) -> str:
    """``target`` with the chords of ``donor`` at the word starts nearest to their scaled places."""
    plain, found = "", []
    for m in re.finditer(r"\[([^\]]+)\]|[^\[]+|\[", donor):
        if m[1] is None:
            plain += m[0]
        else:
            found.append((len(plain), m[1]))
    out, words = target, [w.start() for w in re.finditer(r"\S+", target)] or [0]
    for pos, name in reversed(found):
        x = round(pos / max(1, len(plain)) * len(target))
        snap = min(words, key=lambda w: (abs(w - x), w))
        out = out[:snap] + f"[{name}]" + out[snap:]
    return out


def _sectioned(df: DataFrame) -> DataFrame:
    """Lines with the label of the last comment before them, lower-cased, as ``section``, and whether they are one."""
    s = stripped(F.col("line"))
    comment = F.lower(s).startswith("{comment:") & s.endswith("}")
    label = F.lower(F.trim(F.regexp_extract(s, r"(?i)^\{comment:(.*)\}$", 1)))
    section = F.coalesce(F.last(F.when(comment, label), ignorenulls=True).over(so_far()), F.lit(""))
    return df.select("doc_id", "line_no", "line", section.alias("section"), comment.alias("is_comment"))


def transfer_chords(lines: DataFrame, donors: DataFrame, least: float = 0.32, few: int = 6) -> DataFrame:
    """Chords of a donor version carried to like lyric lines of the same section, each donor line used once.

    Lines take their best donor in order; a section that the donor does not have may use all its lines.
    Documents with ``few`` chords or more, or whose donor has at most two more, stay as they are.
    Similarities are computed in Spark; only the pairs that reach ``least`` are folded, by document.
    """
    a, b = _sectioned(lines), _sectioned(donors)
    give = b.filter(~F.col("is_comment") & (count_brackets(F.col("line")) > 0))
    give = give.withColumn("first", F.min("line_no").over(Window.partitionBy("doc_id", "section")))
    give = give.select("doc_id", "section", "first", F.col("line_no").alias("donor_no"), F.col("line").alias("donor"), lyric_key(F.col("line")).alias("__b"))
    have = a.groupBy("doc_id").agg(F.sum(count_brackets(F.col("line"))).alias("have"))
    offer = give.groupBy("doc_id").agg(F.sum(count_brackets(F.col("donor"))).alias("offer"))
    gains = have.join(offer, "doc_id").filter((F.col("have") < few) & (F.col("offer") > F.col("have") + 2)).select("doc_id")
    s = stripped(F.col("line"))
    want = a.filter((s != "") & ~s.startswith("{") & (count_brackets(s) == 0)).join(gains, "doc_id", "left_semi")
    want = want.select("doc_id", "section", "line_no", s.alias("target"), lyric_key(F.col("line")).alias("__a")).filter("__a <> ''")
    known = give.select("doc_id", "section").distinct()
    own = want.join(give, ["doc_id", "section"]).drop("section")
    other = want.join(known, ["doc_id", "section"], "left_anti").drop("section").join(give.drop("section"), "doc_id")
    similarity = lyric_similarity(F.col("__a"), F.col("__b"))
    pairs = own.unionByName(other).filter("__b <> ''").withColumn("similarity", similarity).filter(F.col("similarity") >= least)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_no", "similarity", "first", "donor_no"], ascending=[True, False, True, True], kind="stable")
        used, done, out = set(), None, []
        for line_no, target, donor in zip(pdf["line_no"], pdf["target"], pdf["donor"], strict=True):
            if line_no != done and donor not in used:
                used.add(donor)
                done = line_no
                out.append((line_no, place_chords(target, donor)))
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "line_no": [n for n, _ in out], "new": [x for _, x in out]})

    new = _by_document(pairs.select("doc_id", "line_no", "target", "first", "donor_no", "donor", "similarity"), step, "doc_id long, line_no int, new string")
    out = lines.select("doc_id", "line_no", "line").join(new, ["doc_id", "line_no"], "left")
    return out.select(F.col("doc_id").cast("long"), F.col("line_no").cast("int"), F.coalesce("new", "line").alias("line"))
