"""Image operators on decoded pages: threshold, rule removal, staff detection.

Pages are binary PGM or PPM (P5, P6); other formats need a decoder, which may be passed in.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def decode_pnm(data: bytes) -> np.ndarray:
    """Grey values of a binary PGM or PPM."""
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[4]) > 255:
        raise ValueError("not an 8-bit binary PGM or PPM")
    w, h = int(m[2]), int(m[3])
    if m[1] == b"P5":
        return np.frombuffer(data, np.uint8, w * h, m.end()).reshape(h, w)
    rgb = np.frombuffer(data, np.uint8, 3 * w * h, m.end()).reshape(h, w, 3).astype(float)
    return np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def encode_pgm(grey: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.ascontiguousarray(grey, np.uint8).tobytes()


def otsu_threshold(grey: np.ndarray) -> int:
    """The grey value that parts dark from light with the largest variance between both; 128 without any."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    back, front = w, w[-1] - w
    ok = (back > 0) & (front > 0)
    v = np.zeros(256)
    v[ok] = back[ok] * front[ok] * (s[ok] / back[ok] - (s[-1] - s[ok]) / front[ok]) ** 2
    return int(v.argmax()) if v.max() > 0 else 128


def binarised(grey: np.ndarray, threshold: int | None = None, invert: bool = False) -> np.ndarray:
    white = grey >= (otsu_threshold(grey) if threshold is None else threshold)
    return np.where(white != invert, 255, 0).astype(np.uint8)


def _runs(dark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of horizontal dark runs."""
    edge = np.diff(np.pad(dark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1] - start


def without_rules(grey: np.ndarray, share: float = 0.3, dark: int = 128) -> np.ndarray:
    """Horizontal dark runs of at least ``share`` of the width made white."""
    out = grey.copy()
    for y, x, n in zip(*_runs(grey < dark), strict=True):
        if n >= share * grey.shape[1]:
            out[y, x : x + n] = 255
    return out


def row_profile(grey: np.ndarray, dark: int = 230, step: int = 1) -> list[tuple[int, int, int, int]]:
    """``(y, dark pixels, longest run, changes)`` of every ``step``-th row."""
    d = grey[::step] < dark
    longest = np.zeros(len(d), int)
    row, _, n = _runs(d)
    np.maximum.at(longest, row, n)
    changes = (d[:, 1:] != d[:, :-1]).sum(1)
    return [(int(i * step), int(c), int(m), int(t)) for i, (c, m, t) in enumerate(zip(d.sum(1), longest, changes, strict=True))]


def bands(rows: list[int], gap: int = 6) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for y in sorted(rows):
        if out and y - out[-1][1] <= gap:
            out[-1][1] = y
        else:
            out.append([y, y])
    return [(a, b) for a, b in out]


def staff_starts(centres: list[float], height: int, uneven: float = 0.45, least: float = 6.0, most: float = 24.0) -> list[int]:
    """Indexes at which five evenly spaced bands begin."""
    out = []
    for i in range(len(centres) - 4):
        gaps = np.diff(centres[i : i + 5])
        mean = gaps.mean()
        if (np.abs(gaps - mean) <= uneven * mean).all() and least <= mean <= min(most, 0.06 * height):
            out.append(i)
    return out


def looks_like_staff(grey: np.ndarray, share: float = 0.12, thick: int = 10) -> bool:
    """Whether a page of at least 200 by 150 shows a staff of five rules."""
    h, w = grey.shape
    if w < 200 or h < 150:
        return False
    rows = [y for y, _, run, changes in row_profile(grey, step=2) if run >= share * w and changes <= max(12, w // 15)]
    thin = [b for b in bands(rows) if b[1] - b[0] <= thick]
    return bool(staff_starts([(a + b) / 2 for a, b in thin], h))


def without_staves(grey: np.ndarray, share: float = 0.3, pad: int = 2) -> np.ndarray:
    """Rows of staves made white, with ``pad`` rows around; five bands at a time."""
    out, h = grey.copy(), grey.shape[0]
    rows = [y for y, _, run, _ in row_profile(grey, 128) if run >= share * grey.shape[1]]
    found = bands(rows, 5)
    centres, skip = [(a + b) / 2 for a, b in found], -1
    for i in staff_starts(centres, h):
        if i > skip:
            for a, b in found[i : i + 5]:
                out[max(0, a - pad) : b + pad + 1] = 255
            skip = i + 4
    return out


def preprocess(pages: DataFrame, invert: bool = False, rules: bool = True, decode: Callable[[bytes], np.ndarray] = decode_pnm) -> DataFrame:
    """Pages ``(path, content)`` ready for recognition: black and white, rules and staves removed; null if undecodable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    page = binarised(decode(content.as_py() or b""), invert=invert)
                    out, staff = encode_pgm(without_rules(without_staves(page)) if rules else page), looks_like_staff(page)
                except ValueError:
                    out, staff = None, None
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([out], pa.binary()), pa.array([staff], pa.bool_())], ["path", "content", "has_staff"])

    return pages.select("path", "content").mapInArrow(run, "path string, content binary, has_staff boolean")


def profiles(pages: DataFrame, step: int = 2, decode: Callable[[bytes], np.ndarray] = decode_pnm) -> DataFrame:
    """Row profiles of pages: ``(path, y, dark_count, max_run, transitions)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = row_profile(decode(content.as_py() or b""), step=step)
                if got:
                    y, c, m, t = (pa.array(x, pa.int32()) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(got)), y, c, m, t], ["path", "y", "dark_count", "max_run", "transitions"])

    return pages.select("path", "content").mapInArrow(run, "path string, y int, dark_count int, max_run int, transitions int")
