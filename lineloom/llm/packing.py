"""Packing token sequences by best-fit decreasing.

A document is its token ids and an end id.  Overlong documents are cut into full windows and a rest;
rests are placed in order of decreasing length, each into the open window that it fills most
tightly.  A segment tree over remaining capacities finds that window in a logarithmic number of
steps.  Every task packs the documents of its own partition: it holds a few numbers a document, not
the ids, and no document is moved.  A window's id is the partition's number and a count.

A null or empty text is its end id alone.  Repeated ids and texts are packed row by row; very long
texts become full windows and a rest; columns other than id and text are not looked at, so their
names do not matter.  An empty table has no piece.  Special tokens written in a text are what the
tokenizer makes of them.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words, as written and in small letters, whose ids a worker remembers.
CACHE_WORDS = 150_000
CACHE_PIECES = 300_000
_MARKS = string.punctuation


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


_LETTERS = byte_letters()


class _Words(dict):
    """Word to its ids as little-endian bytes, for a tokenizer that never joins words across white space.

    The tokenizer folds case and parts letters from marks, so a word of Latin letters with marks after
    it has the ids of its small letters and those of its marks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}

    def _encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            # One pre-token in its normal form: the model alone gives its ids.
            letters = piece if piece.isascii() else "".join([_LETTERS[b] for b in piece.encode()])
            got = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
            if len(piece) < 64:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) <= "ÿ"):
            got = self._piece(core.lower())
            if len(core) < len(word):
                got += self._piece(word[len(core) :])
        else:
            got = self._encode(word)
        if len(word) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = got
        return got


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def token_bytes(text: str | None, words: _Words, end_id: int = END_ID) -> bytes:
    """The ids of one whole text and the end id, as little-endian unsigned 32-bit numbers.

    Blanks and line ends split the text first: the tokenizer drops white space and ends words there,
    so the ids are those of the text as a whole.
    """
    return b"".join(map(words.__getitem__, (text or "").replace("\n", " ").split(" "))) + end_id.to_bytes(4, "little")


class BestFit:
    """Open windows by remaining capacity."""

    def __init__(self, window: int):
        self.window = window
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.made = 0

    def _count(self, capacity: int, by: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += by
            i >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that some open window has, or -1."""
        tree, i = self.tree, need + self.size
        if tree[i]:
            return need
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i *= 2
                    if not tree[i]:
                        i += 1
                return i - self.size
            i >>= 1
        return -1

    def place(self, length: int) -> tuple[int, int]:
        """The window and the offset that a piece of ``length`` gets."""
        capacity = self.tightest(length) if length < self.window else -1
        if capacity < 0:
            at, capacity = self.made, self.window
            self.made += 1
        else:
            at = self.open[capacity].pop()
            self._count(capacity, -1)
        if capacity > length:
            self.open[capacity - length].append(at)
            self._count(capacity - length, 1)
        return at, self.window - capacity


def pack_lengths(lengths: Sequence[int], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window numbers and offsets of pieces, placed by decreasing length (ties in the order given)."""
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and not (1 <= lengths.min() and lengths.max() <= window):
        raise ValueError("a piece must have between one id and a full window")
    fit, at, offset = BestFit(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        at[i], offset[i] = fit.place(int(lengths[i]))
    return at, offset


def pack(documents: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and its ``ids`` if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(vocabulary)
        docs, starts, lengths, sums, totals, kept = [], [], [], [], [], []
        for b in slices(batches, "text"):
            for doc, text in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist(), strict=True):
                ids = token_bytes(text, words, end_id)
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    docs.append(doc)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(n)
                    if with_ids:
                        kept.append(part)
        at, offset = pack_lengths(lengths, window)
        at += TaskContext.get().partitionId() << 32
        step = 20_000 if not with_ids else 500
        for i in range(0, len(docs), step):
            cut = slice(i, i + step)
            columns = [pa.array(docs[cut], pa.int64()), pa.array(starts[cut], pa.int64()), pa.array(lengths[cut], pa.int64()), pa.array(sums[cut], pa.int64()), pa.array(totals[cut], pa.int64()), pa.array(at[cut]), pa.array(offset[cut])]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in kept[cut]], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
