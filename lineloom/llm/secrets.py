"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials.

The base patterns find assignments, access keys and long hexadecimal runs.  Their distinct matches in
all documents are the labelled credentials, a format being a kind and a length; formats that the base
patterns cannot label start from examples made by rule.  All examples of a format are counted, over
character classes, in an acceptor whose states are a place and the last ORDER symbols before it (the
prefix tree, folded below that depth, so that its size does not grow with the examples), and states
whose futures (symbols, ends, and lengths of what remains) are statistically compatible are merged,
which leaves a probabilistic automaton.  The other characters of all documents are the negatives: they
give a background model of character pairs.

Candidates are all parts of runs of token characters that begin with the run, after a mark or with a
format's beginning and end at a mark or with the run.  Each is scored by the logarithm of its
likelihood under each format over that under the background, and is a secret where the prior odds of
a secret are overcome.  Nothing but the automata's own likelihood, which is zero for a token that they
cannot spell, decides on lengths, digits or beginnings.  Of overlapping ones the likelier is kept.
Learned spans are reported wherever they lie, also within base spans.

Null and empty texts have no spans; very long texts are searched whole.  Offsets are code points, ends
exclusive.  Repeated ids are separate rows, an empty table has none, and of other columns only
``n_chars`` is looked at, when texts are redacted.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, slices

#: Symbols before a place that tell its states apart before any are merged.
ORDER = 3
#: Counts of symbols that a task holds before it passes them on.
COUNTS = 200_000
#: Fewest examples of a format, and the most characters of one: longer values give no example.
LEAST, LONGEST = 24, 256
ALPHA = 0.01
#: Log-odds that a candidate must overcome to be taken for a secret: one in a million.
PRIOR = math.log(1e6)
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Marks within a run at which a key may begin or end.
MARKS = re.compile(r"[=/.+-]")
#: Public key formats that the base patterns cannot label: literal beginning, alphabet, length of the rest.  Fixed values.
FORMATS = {
    "forge": ("ghp_", string.ascii_letters + string.digits, 36),
    "payment": ("sk_live_", string.ascii_letters + string.digits, 24),
    "maps": ("AIza", string.ascii_letters + string.digits + "_-", 35),
}
#: Classes of characters, any other character being a class of its own.
CLASSES = {"0": string.digits, "f": "abcdef", "z": "ghijklmnopqrstuvwxyz", "F": "ABCDEF", "Z": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS = {c: k for k, cs in CLASSES.items() for c in cs}
_SHARE = {k: -math.log(len(cs)) for k, cs in CLASSES.items()}

_SYMBOL = re.compile("=?.", re.DOTALL)

Span = tuple[str, int, int]
#: A length of examples, a place, the last ORDER symbols before it, and the symbol there.
Gram = tuple[int, int, str, str]


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns: leftmost, not overlapping within a kind; too short matches dropped."""
    text = text or ""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if any(len(w) >= 24 for w in text.split()):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return ordered(out)


def ordered(spans: Sequence[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def tally(examples: Iterable[str]) -> dict[Gram, list]:
    """How often each symbol follows those before it, with the least and the greatest character that it stood for."""
    out: dict[Gram, list] = {}
    for e in examples:
        symbols = [_CLASS.get(c, "=" + c) for c in e]
        for i, c in enumerate(e):
            gram = len(e), i, "".join(symbols[max(0, i - ORDER) : i]), symbols[i]
            seen = out.get(gram)
            if seen is None:
                out[gram] = [1, c, c]
            else:
                seen[0] += 1
                if not seen[1] <= c <= seen[2]:
                    seen[1:] = min(seen[1], c), max(seen[2], c)
    return out


class Automaton:
    """A probabilistic automaton merged from the counts (:func:`tally`) of all ``examples``.

    A symbol is a character where all examples have the same one, else its class.  States are merged
    in order of their distance from the start, into the first state that is compatible: all shares of
    symbols, of ends, and of lengths that remain differ by less than the Hoeffding bound, and so on
    for the states that the symbols lead to.
    """

    def __init__(self, examples: Iterable[str] = (), alpha: float = ALPHA, grams: Mapping[Gram, Sequence] | None = None):
        grams = tally(examples) if grams is None else grams
        sizes = {size for size, *_ in grams}
        chars: list[set[str]] = [set() for _ in range(min(sizes, default=0))]
        for (_, i, _, _), (_, low, high) in grams.items():
            if i < len(chars):
                chars[i] |= {low, high}
        self.fixed = [len(x) == 1 and min(x) for x in chars]
        if len(sizes) == 1 and all(self.fixed):  # a single example
            self.fixed = [False] * len(chars)
        self.next: list[dict[str, int]] = [{}]
        self.uses: list[dict[str, int]] = [{}]
        self.left: list[Counter[int]] = [Counter()]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._count(grams)
        self.up = list(range(len(self.next)))
        self._merge()
        self._finish()

    def _symbol(self, i: int, c: str) -> str:
        # Marked, so that a character is not mistaken for a class, nor one met where it is fixed for another.
        return "!" + c if i < len(self.fixed) and self.fixed[i] == c else _CLASS.get(c, "=" + c)

    def _count(self, grams: Mapping[Gram, Sequence]) -> None:
        places = {(0, ""): 0}

        def state(i: int, before: str) -> int:
            s = places.setdefault((i, before), len(self.next))
            if s == len(self.next):
                self.next.append({})
                self.uses.append({})
                self.left.append(Counter())
            return s

        for gram in sorted(grams):
            (size, i, before, symbol), n = gram, grams[gram][0]
            s, t = state(i, before), state(i + 1, "".join(_SYMBOL.findall(before + symbol)[-ORDER:]))
            c = "!" + self.fixed[i] if i < len(self.fixed) and self.fixed[i] else symbol
            self.left[s][size - i] += n
            self.uses[s][c] = self.uses[s].get(c, 0) + n
            self.next[s][c] = t
            if i + 1 == size:
                self.left[t][0] += n

    def _top(self, s: int) -> int:
        """The state that ``s`` has been merged into."""
        while self.up[s] != s:
            self.up[s] = self.up[self.up[s]]
            s = self.up[s]
        return s

    def _alike(self, a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            p, q = map(self._top, todo.pop())
            if p == q or (p, q) in met:
                continue
            met.add((p, q))
            n, m = self.left[p].total(), self.left[q].total()
            room = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            # What remains is compared as it is: states at other distances from the end are no match, however rare.
            if not self.left[p].keys() & self.left[q].keys():
                return False
            for x, y in ((self.left[p], self.left[q]), (self.uses[p], self.uses[q])):
                if any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > room for c in x.keys() | y.keys()):
                    return False
            todo += [(self.next[p][c], self.next[q][c]) for c in self.next[p].keys() & self.next[q].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            p, q = map(self._top, todo.pop())
            if p == q:
                continue
            self.up[q] = p
            self.left[p].update(self.left[q])
            for c, n in self.uses[q].items():
                self.uses[p][c] = self.uses[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge(self) -> None:
        ring = [0]
        while ring:
            kept: list[int] = []
            for p in ring:
                for c in sorted(self.next[p]):
                    b = self._top(self.next[p][c])
                    if b in kept:
                        continue
                    same = next((r for r in kept if self._alike(r, b)), None)
                    if same is None:
                        kept.append(b)
                    else:
                        self._fold(same, b)
            ring = kept

    def _finish(self) -> None:
        self.next = [{c: self._top(t) for c, t in step.items()} for step in self.next]
        reach, todo = [0], [0]
        while todo:
            new = sorted(set(self.next[todo.pop()].values()) - set(reach))
            reach += new
            todo += new
        number = {s: i for i, s in enumerate(reach)}
        # A symbol that the format has, but not in this state, counts half a time.
        known = {c for s in reach for c in self.uses[s] if c[0] != "!"}
        steps, ends = [], []
        for s in reach:
            n, left = self.left[s].total(), self.left[s]
            unseen = known - self.uses[s].keys() if self.uses[s] and all(c[0] != "!" for c in self.uses[s]) else set()
            total = n + 0.5 * len(unseen)
            # Where an unseen symbol leads: to the most used state.
            usual = self.next[s][max(self.uses[s], key=lambda c: (self.uses[s][c], c))] if self.uses[s] else 0
            step = {c: (number[self.next[s][c]], math.log(k / total) + _SHARE.get(c, 0.0)) for c, k in self.uses[s].items()}
            step |= {c: (number[usual], math.log(0.5 / total) + _SHARE.get(c, 0.0)) for c in unseen}
            steps.append(step)
            ends.append(math.log(left[0] / n) if left[0] else None)
        self.steps, self.ends = steps, ends
        del self.next, self.uses, self.left, self.up
        self.shortest = self._shortest()
        beginning = ""
        while len(beginning) < len(self.fixed) and self.fixed[len(beginning)]:
            beginning += self.fixed[len(beginning)]
        self.beginning = beginning

    def _shortest(self) -> int:
        ring, n, seen = {0}, 0, set()
        while ring and all(self.ends[s] is None for s in ring):
            seen |= ring
            ring, n = {t for s in ring for t, _ in self.steps[s].values()} - seen, n + 1
        return n

    @property
    def states(self) -> int:
        return len(self.steps)

    def prefixes(self, token: str, start: int, stops: set[int]) -> Iterator[tuple[int, float]]:
        """``(stop, log-likelihood of token[start:stop])`` for the stops where the automaton may end."""
        s, total, i = 0, 0.0, start
        while True:
            if i in stops and i > start and self.ends[s] is not None:
                yield i, total + self.ends[s]
            if i == len(token):
                return
            c = token[i]
            step = self.steps[s].get(self._symbol(i - start, c)) or self.steps[s].get(_CLASS.get(c, "=" + c))
            if step is None:
                return
            s, total, i = step[0], total + step[1], i + 1

    def likelihood(self, token: str) -> float:
        """The logarithm of a token's likelihood; minus infinity if it cannot be spelt."""
        return next((p for _, p in self.prefixes(token, 0, {len(token)})), -math.inf)


class Background:
    """Likelihood of ordinary text by pairs of characters; characters beyond ASCII are one.

    One occurrence of each pair is left out, so that a credential does not pass for ordinary by its own
    pairs; ROOM occurrences after each character are dealt by the characters' shares.
    """

    ROOM = 20.0

    def __init__(self, pairs: np.ndarray):
        pairs = np.maximum(pairs.reshape(128, 128) - 1, 0)
        share = pairs.sum(0) + 1
        pairs = pairs + self.ROOM * share / share.sum()
        self.log = np.log(pairs / pairs.sum(1, keepdims=True))

    def sums(self, token: str) -> np.ndarray:
        """Sums of the logarithms over the first characters of ``token``, as if it stood after a blank; the end is a blank again."""
        at = np.frombuffer(token.encode("ascii", "replace"), np.uint8).astype(np.int64)
        return np.concatenate([[0.0], np.cumsum(self.log[np.concatenate([[32], at[:-1]]), at])])

    def likelihood(self, token: str) -> float:
        return float(self.sums(token)[-1])


def pair_counts(texts: Sequence[str | None]) -> np.ndarray:
    """How often each pair of characters (beyond ASCII: 127) stands in ``texts`` outside of base spans."""
    out = np.zeros(128 * 128, np.int64)
    for t in texts:
        at, parts = 0, []
        for _, a, b in base_spans(t):
            parts.append((t or "")[at : max(at, a)])
            at = max(at, b)
        for part in [*parts, (t or "")[at:]]:
            c = np.minimum(np.frombuffer(part.encode("utf-32-le"), np.uint32), 127).astype(np.int64)
            if len(c) > 1:
                out += np.bincount(c[:-1] * 128 + c[1:], minlength=128 * 128)
    return out


def made_examples(per_format: int = 96, seed: int = 11) -> dict[str, list[str]]:
    """Examples of the public formats, made by rule."""
    rng = random.Random(seed)
    return {k: [head + "".join(rng.choices(abc, k=n)) for _ in range(per_format)] for k, (head, abc, n) in FORMATS.items()}


@dataclass
class Model:
    automata: dict[str, Automaton]
    background: Background
    prior: float = PRIOR

    def __post_init__(self) -> None:
        #: The fewest characters that any automaton can spell.
        self.shortest = min((m.shortest for m in self.automata.values()), default=0)
        self.run = re.compile(rf"[A-Za-z0-9+/_.=-]{{{max(1, self.shortest)},}}")

    def learned(self, text: str) -> list[tuple[int, int, str, float]]:
        """``(start, end, format, log of the likelihood ratio)`` of the secrets of a whole text, in order; none overlap."""
        out: list[tuple[int, int, str, float]] = []
        if not self.automata:
            return out
        for run in self.run.finditer(text):
            token = run[0]
            marks = [m.start() for m in MARKS.finditer(token)]
            starts, stops = {0, *(k + 1 for k in marks)}, {*marks, len(token)}
            usual: np.ndarray | None = None
            found = []
            for name, m in self.automata.items():
                heads = starts
                if len(m.beginning) >= 3:
                    heads = {x.start() for x in re.finditer("(?=" + re.escape(m.beginning) + ")", token)}
                for x in heads:
                    if x + m.shortest > len(token):
                        continue
                    for y, p in m.prefixes(token, x, stops):
                        if usual is None:
                            usual = self.background.sums(token)
                        ratio = p - float(usual[y] - usual[x])
                        if ratio > self.prior:
                            found.append((ratio, x, y, name))
            kept: list[tuple[float, int, int, str]] = []
            for f in sorted(found, key=lambda f: (-f[0], f[1], f[2], f[3])):
                if all(f[2] <= u or f[1] >= v for _, u, v, _ in kept):
                    kept.append(f)
            out += sorted((run.start() + x, run.start() + y, name, ratio) for ratio, x, y, name in kept)
        return out


def fit(documents: DataFrame) -> Model:
    """Automata of the formats seen in ``documents`` and of the public ones, and the background; all rows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(128 * 128, np.int64)
        names = ["kind", "value", "pairs"]
        for b in slices(batches, "text"):
            texts = column(b, "text").to_pylist()
            pairs += pair_counts(texts)
            got = {(k, t[x:y] if k != "assign" else ASSIGN.match(t, x)[2]) for t in texts if t for k, x, y in base_spans(t)}
            got = sorted(g for g in got if len(g[1]) <= LONGEST)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got]), pa.array([v for _, v in got]), pa.nulls(len(got), pa.list_(pa.int64()))], names)
        yield pa.RecordBatch.from_arrays([pa.array(["pairs"]), pa.nulls(1, pa.string()), pa.array([pairs], pa.list_(pa.int64()))], names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, Gram], list] = {}

        def passed() -> pa.RecordBatch:
            cols = zip(*((k, *gram, *seen) for (k, gram), seen in held.items()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "size", "at", "before", "symbol", "n", "low", "high"])

        for b in batches:
            kinds, values = column(b, "kind").to_pylist(), column(b, "value").to_pylist()
            for kind in sorted(set(kinds)):
                for gram, (n, low, high) in tally(v for k, v in zip(kinds, values, strict=True) if k == kind).items():
                    seen = held.setdefault((kind, gram), [0, low, high])
                    seen[:] = seen[0] + n, min(seen[1], low), max(seen[2], high)
            if len(held) >= COUNTS:
                yield passed()
                held.clear()
        if held:
            yield passed()

    found = checkpointed(documents.select("text").mapInArrow(run, "kind string, value string, pairs array<long>"))
    # Of fixed size: one number a pair of characters, summed in Spark.
    sums = found.filter("kind = 'pairs'").select(F.posexplode("pairs").alias("at", "n")).filter("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(128 * 128)
    for r in sums:
        pairs[r["at"]] = r["n"]
    # A format is a kind and a length: a bounded number, each with a bounded number of counts.
    words = found.filter("kind <> 'pairs'").select("kind", "value").distinct()
    parts = words.mapInArrow(counted, "kind string, size long, at long, before string, symbol string, n long, low string, high string")
    grams = checkpointed(parts.groupBy("kind", "size", "at", "before", "symbol").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))
    formats = grams.filter("at = 0").groupBy("kind", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST).collect()
    automata = {k: Automaton(v) for k, v in made_examples().items()}
    for k in formats:
        rows = grams.filter((F.col("kind") == k["kind"]) & (F.col("size") == k["size"])).collect()
        automata[f"{k['kind']}{k['size']}"] = Automaton(grams={(r["size"], r["at"], r["before"], r["symbol"]): (r["n"], r["low"], r["high"]) for r in rows})
    return Model(dict(sorted(automata.items())), Background(pairs))


def spans(text: str | None, model: Model) -> tuple[list[Span], list[Span], list[float]]:
    """The base spans of a whole text, all spans, and the log-likelihood ratios of the learned ones."""
    base, learned = base_spans(text), model.learned(text or "")
    return base, ordered([*base, *(("learned", a, b) for a, b, _, _ in learned)]), [r for _, _, _, r in learned]


def redacted(text: str, found: Sequence[Span], mark: str = "[secret]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def report(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, likelihoods)`` of every row.

    ``likelihoods`` holds the log-likelihood ratio of each learned span, in their order.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [spans(t, shared.value) for t in column(b, "text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _, _ in got], pa.int64()) for k in KINDS[:3]]
            sums = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _, _ in got], pa.string())
            ratios = pa.array([r for _, _, r in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), *counts, sums, pa.array([joined(every) for _, every, _ in got], pa.string()), ratios], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "likelihoods"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, likelihoods array<double>")


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """``documents``, all rows and columns, with secrets of ``text`` replaced and ``n_chars`` (if there) recounted."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [t and redacted(t, spans(t, shared.value)[1]) for t in column(b, "text").to_pylist()]
            new = {"text": pa.array(texts, column(b, "text").type)}
            if "n_chars" in b.schema.names:
                old = column(b, "n_chars")
                new["n_chars"] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([new.get(f.name, column(b, f.name)) for f in b.schema], [f.name for f in b.schema])

    return documents.mapInArrow(run, documents.schema)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(documents, fit(documents))
