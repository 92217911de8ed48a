"""Recognition engines as plug-ins: what renders pages and reads them lives outside; tables come in.

An engine is any object with ``read(page: bytes) -> str`` (text) or ``-> list of words`` (layout).  It is
built on the executors, once a worker, by a factory registered by name.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

WORDS = "path string, page_no int, word_no int, text string, left double, top double, right double, bottom double, score double"


class TextEngine(Protocol):
    def read(self, page: bytes) -> str: ...


class LayoutEngine(Protocol):
    def read(self, page: bytes) -> list[tuple[str, float, float, float, float, float]]: ...


_FACTORIES: dict[str, Callable[[], object]] = {}
_ENGINES: dict[str, object] = {}


def register(name: str, factory: Callable[[], object]) -> None:
    """Names an engine; the factory must be importable on the executors."""
    _FACTORIES[name.lower()] = factory
    _ENGINES.pop(name.lower(), None)


def engine(name: str) -> object:
    """The engine of a name, built at first use and kept by the worker."""
    key = name.lower()
    if key not in _FACTORIES:
        raise KeyError(f"no engine named {name!r}; known: {sorted(_FACTORIES)}")
    if key not in _ENGINES:
        _ENGINES[key] = _FACTORIES[key]()
    return _ENGINES[key]


class Timed:
    """An engine with a time limit a page; after ``most`` overruns it gives empty texts without trying."""

    def __init__(self, inner: TextEngine, seconds: float = 30.0, most: int = 3):
        self.inner, self.seconds, self.most, self.late = inner, seconds, most, 0

    def read(self, page: bytes) -> str:
        if self.late >= self.most:
            return ""
        got: list[str] = []
        worker = threading.Thread(target=lambda: got.append(self.inner.read(page)), daemon=True)
        worker.start()
        worker.join(self.seconds)
        if worker.is_alive():
            self.late += 1
            return ""
        return got[0] if got else ""


def read_text(pages: DataFrame, make: Callable[[], TextEngine]) -> DataFrame:
    """``(path, page_no, text, error)`` of ``pages(path, page_no, content)``; a page that fails is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for b in batches:
            texts, errors = [], []
            for content in b.column(2):
                try:
                    texts.append(reader.read(content.as_py() or b""))
                    errors.append(None)
                except Exception as e:  # the engine is foreign: whatever it raises belongs to its page
                    texts.append("")
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "page_no", "text", "error"])

    return pages.select("path", "page_no", "content").mapInArrow(run, "path string, page_no int, text string, error string")


def read_words(pages: DataFrame, make: Callable[[], LayoutEngine]) -> DataFrame:
    """Word boxes of pages as rows of WORDS, words from the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for b in batches:
            for path, page, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = sorted(reader.read(content.as_py() or b""), key=lambda w: (w[2], w[1]))
                if words:
                    columns = list(zip(*words, strict=True))
                    arrays = [pa.array([path] * len(words), pa.string()), pa.array([page] * len(words), pa.int32()), pa.array(range(len(words)), pa.int32()), pa.array(columns[0], pa.string()), *(pa.array(c, pa.float64()) for c in columns[1:])]
                    yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in WORDS.split(", ")])

    return pages.select("path", "page_no", "content").mapInArrow(run, WORDS)
