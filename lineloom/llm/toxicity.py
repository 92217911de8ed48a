"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters are words, word beginnings (for languages that inflect) and patterns of the whole text.  They
are chosen with labelled rows: those that are right at least twice as often as wrong, by an association
that chance would not give one term of all that were tried.  A voter fires, for toxic, or abstains.

The label model is generative and sees votes only.  Given the hidden class a voter fires at a rate of
its own, which also depends on whether the voter fires that it is most correlated with: a tree of
voters by mutual information given the class, so one that repeats another adds nothing.  Rates, tree
and the rate at which no voter fires are estimated from the votes by expectation-maximisation.  What
tells the classes apart is that a firing voter never speaks against toxicity and an abstaining one says
nothing (a lexicon of one language is no evidence on texts of another).  Labels give the model the
share of toxic rows and nothing else.

The posterior labels of the rows, and those of rows on which a single voter fires, train a logistic
classifier on the voters, which scores every document.

Of labelled rows, copies count once: those whose five-word shingles have the same smallest hash.
Documents of one id are one row for fitting (that of the smallest text) and separate rows for scoring.
Null and empty texts hold no term and score like one; very long texts are searched whole.  Without
toxic or without other labelled rows every score is the share of toxic ones (0.5 without labels).  An
empty table gives no rows; further columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, column, labelled, slices
from .neardup import shingle_hashes
from .quality import training_row

#: Bound on the labelled rows used for fitting.
FIT_ROWS = 16_384
#: Bound on the voters: those of the strongest association.
VOTERS = 1024
#: Fewest toxic rows of a voter, and how many times as often it must be right as wrong.
LEAST, RIGHT = 3, 2.0
#: A beginning is no voter if one of its own words or longer beginnings has this share of its toxic rows.
SAME = 0.95
BEGINNINGS = (4, 5, 6)
#: Words of the shingles that tell copies.
WIDTH = 5
THRESHOLD = 0.3
#: Ridge of the logistic classifier.
RIDGE = 0.1
#: How often the classifier sees each voter alone, with the label model's posterior.
ALONE = 4
#: Rows added to each class's rates, at the rate of both classes together.
SMOOTH = 1.0
_WORD = re.compile(r"\w+")


def patterns_of(text: str) -> set[str]:
    """Patterns that a whole text shows: shouting, exclamation, address by quotes, many marks."""
    n = max(1, len(text))
    shown = {"!shouting": sum(map(str.isupper, text)) * 4 > n, "!exclaiming": text.count("!") * 60 > n, "!quoting": text.count('"') * 200 > n, "!marks": sum(map(text.count, "#$%&*@")) * 40 > n}
    return {name for name, v in shown.items() if v}


def terms_of(text: str | None) -> set[str]:
    """Distinct lower-cased words, beginnings of longer ones marked by ``*``, and patterns marked by ``!``."""
    text = text or ""
    words = set(_WORD.findall(text.lower()))
    out = {w for w in words if len(w) > 2} | patterns_of(text)
    for k in BEGINNINGS:
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


@dataclass
class Model:
    terms: list[str]
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.words = {t: i for i, t in enumerate(self.terms) if t[-1] != "*"}
        self.starts = {k: {t[:-1]: i for i, t in enumerate(self.terms) if t[-1] == "*" and len(t) == k + 1} for k in BEGINNINGS}

    def present(self, text: str | None) -> list[int]:
        """The numbers of the model's terms that a whole text shows."""
        text = text or ""
        words = set(_WORD.findall(text.lower()))
        out = [self.words[w] for w in self.words.keys() & (words | patterns_of(text))]
        for k, table in self.starts.items():
            if table:
                out.extend({table[w[:k]] for w in words if len(w) > k and w[:k] in table})
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + (float(self.weights[self.present(text)].sum()) if len(self.weights) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def offset(odds: np.ndarray, total: float) -> float:
    """What must be taken from ``odds``, if anything, for their probabilities to add up to no more than ``total``."""
    if sigmoid(odds).sum() <= total:
        return 0.0
    low, high = 0.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sigmoid(odds - mid).sum() > total else (low, mid)
    return high


@dataclass
class LabelModel:
    """``evidence[u, j]`` is the log-odds that voter ``j`` adds by firing, if its parent fires (``u`` 1) or not."""

    prior: float
    parent: np.ndarray
    evidence: np.ndarray
    none: float
    offset: float = 0.0

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """The log-odds of toxicity of rows on which some voter fires."""
        up = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        return np.log(self.prior / (1 - self.prior)) - self.offset + (votes * up) @ self.evidence[1] + (votes * (1 - up)) @ self.evidence[0]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability of toxicity of each row of ``votes`` (0 or 1)."""
        return np.where(votes.any(1), sigmoid(self.odds(votes)), self.none)

    def accuracy(self, votes: np.ndarray) -> np.ndarray:
        """Of each voter, the share of toxic rows among those where it fires, as the model sees them."""
        return (self.posterior(votes) @ votes + self.prior) / (votes.sum(0) + 1)


def joint_counts(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``(class, j, k)``: the weight of the rows of a class on which both voters fire; on the diagonal, one does."""
    v = votes.astype(np.float64)
    return np.stack([(v * w[:, None]).T @ v for w in (1 - p, p)])


def dependence(both: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mutual information of each pair of voters given the class, times the number of rows."""
    total = np.zeros(both.shape[1:])
    for n11, n in zip(both, weight, strict=True):
        one = np.diag(n11)
        for a in (0, 1):
            for b in (0, 1):
                x = one[:, None] if a else n - one[:, None]
                y = one[None, :] if b else n - one[None, :]
                cell = n11 if a and b else one[:, None] - n11 if a else one[None, :] - n11 if b else n - one[:, None] - one[None, :] + n11
                cell = np.maximum(cell, 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    total += np.where(cell > 1e-9, cell * np.log(cell * n / (x * y)), 0)
    np.fill_diagonal(total, 0)
    return total


def tree(strength: np.ndarray, least: float = 6.0) -> np.ndarray:
    """Each voter's parent in the forest of greatest total ``strength``; -1 for a root.  Weaker ties than ``least`` do not count."""
    m = len(strength)
    parent, best, best_from, open_ = np.full(m, -1), np.full(m, -1.0), np.full(m, -1), np.ones(m, bool)
    for _ in range(m):
        j = int(np.where(open_, best, -np.inf).argmax())
        open_[j] = False
        if best[j] >= least:
            parent[j] = best_from[j]
        better = open_ & (strength[j] > best)
        best[better], best_from[better] = strength[j][better], j
    return parent


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> LabelModel:
    """A label model of ``votes`` (rows by voters, 0 or 1), from the votes alone; ``prior`` is the share of toxic rows."""
    v = (votes > 0).astype(np.uint8)
    m, fires = v.shape[1], v.any(1)
    prior = float(np.clip(prior, 1e-4, 1 - 1e-4))
    share = np.array([[1 - prior], [prior]])
    p, parent, model = np.where(fires, 0.7, 1e-3), np.full(m, -1), None
    for step in range(rounds):
        both, weight = joint_counts(v, p), np.array([[(1 - p).sum()], [p.sum()]])
        if step % 4 == 0 and step <= 16:
            parent = tree(dependence(both, weight.ravel()))
        has, above = parent >= 0, np.maximum(parent, 0)
        one = both[:, np.arange(m), np.arange(m)]
        up = np.where(has, one[:, above], 0.0)
        pair = np.where(has, both[:, np.arange(m), above], 0.0)
        evidence = []
        for k, n in ((one - pair, weight - up), (pair, up)):
            whole = (k.sum(0) + 1e-9) / (n.sum(0) + 2e-9)
            # Enough added rows of either class that they hold SMOOTH firings where the parent does not fire.
            added = SMOOTH * share / (whole if len(evidence) == 0 else 1.0)
            rate = (k + added * whole) / (n + added)
            evidence.append(np.maximum(0.0, np.log(rate[1] / rate[0])))
        none = (p[~fires].sum() + prior) / ((~fires).sum() + 1)
        model = LabelModel(prior, parent, np.array(evidence), float(none))
        # No more rows are toxic than the prior says: voters that fire alone cannot all be right.
        model.offset = offset(model.odds(v[fires]), prior * len(v))
        new = model.posterior(v)
        moved, p = np.abs(new - p).max(initial=0.0), new
        if moved < 1e-6 and step > 16:
            break
    return model


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (last: the constant) of a ridge logistic regression on soft targets, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (target - p) - penalty * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def _counts(rows: DataFrame, of) -> DataFrame:
    """``(term, n)``: in how many rows ``of(text)`` has a term, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in slices(batches, "text"):
            for t in column(b, "text").to_pylist():
                seen.update(of(t))
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def mined(toxic: DataFrame, other: DataFrame, n_pos: int, n_neg: int, voters: int = VOTERS) -> list[str]:
    """The voters: terms of ``toxic`` rows, counted, tested and ranked in Spark.

    The likelihood-ratio statistic must exceed twice the logarithm of the number of terms tried, so that
    less than one is expected to do so by chance.
    """
    pos = checkpointed(_counts(toxic, terms_of).filter(F.col("n") >= LEAST).withColumnRenamed("n", "pos"))
    neg = _counts(other, terms_of).withColumnRenamed("n", "neg")
    both = pos.join(neg, "term", "left").select("term", F.col("pos").cast("double"), F.coalesce("neg", F.lit(0)).cast("double").alias("neg"))
    part = lambda k, n, p: k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    k, j, n, m = F.col("pos"), F.col("neg"), F.lit(float(n_pos)), F.lit(float(n_neg))
    whole = (k + j) / (n + m)
    strength = F.round(2 * (part(k, n, k / n) + part(j, m, j / m) - part(k, n, whole) - part(j, m, whole)), 6)
    rows = both.filter((k > RIGHT * j) & (k / n > j / m) & (strength > 2 * math.log(max(2, pos.count()))))
    found = {r["term"]: r["pos"] for r in rows.orderBy(strength.desc(), "term").limit(voters).collect()}
    longer: dict[str, float] = {}
    for t, n_t in found.items():
        stem = t.rstrip("*")
        for size in BEGINNINGS:
            if size < len(stem) and t[0] != "!":
                longer[stem[:size] + "*"] = max(n_t, longer.get(stem[:size] + "*", 0.0))
    return sorted(t for t, n_t in found.items() if longer.get(t, 0.0) < SAME * n_t)


def training_rows(documents: DataFrame, labels: DataFrame, keep: Column, bound: int) -> DataFrame:
    """``(text, label)``: one row a labelled id, about ``bound`` at most, however many documents share it, and one row a group of copies."""
    y = labelled(labels, "toxic", keep, bound)
    texts = documents.select("doc_id", "text").join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes = [shingle_hashes(t, WIDTH) for t in column(b, "text").to_pylist()]
            least = pa.array(np.array([h.min() if len(h) else 0 for h in hashes], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([column(b, "text"), column(b, "label"), least], ["text", "label", "least"])

    keyed = texts.select("text", "label").mapInArrow(run, "text string, label int, least long")
    return checkpointed(keyed.groupBy("least").agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label"))


def votes_of(rows: DataFrame, blank: Model) -> tuple[np.ndarray, np.ndarray]:
    """The voters that fire on each row (0 or 1) and the rows' labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(b, "label").cast(pa.int32()), pa.array([blank.present(t) for t in column(b, "text").to_pylist()], pa.list_(pa.int32()))], ["label", "at"])

    got = rows.mapInArrow(run, "label int, at array<int>").collect()
    votes = np.zeros((len(got), len(blank.terms)), np.uint8)
    for i, r in enumerate(got):
        votes[i, r["at"]] = 1
    return votes, np.array([r["label"] > 0 for r in got])


def fit(documents: DataFrame, labels: DataFrame, keep: Column, bound: int = FIT_ROWS) -> Model:
    """A model of ``labels.toxic`` over at most about ``bound`` labelled rows for which ``keep`` holds."""
    rows = training_rows(documents, labels, keep, bound)
    n_pos, n = rows.agg(F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    if n_pos in (0, n):
        share = (n_pos + 0.5) / (n + 1)
        return Model([], np.zeros(0), float(np.log(share / (1 - share))))
    chosen = mined(rows.filter("label > 0"), rows.filter("label <= 0"), n_pos, n - n_pos)
    votes, _ = votes_of(rows, Model(chosen, np.zeros(0), 0.0))
    model, alone = label_model(votes, n_pos / n), np.eye(len(chosen), dtype=np.uint8)
    x, target = np.vstack([votes, *[alone] * ALONE]), np.concatenate([model.posterior(votes), *[model.posterior(alone)] * ALONE])
    w = logistic(x.astype(np.float64), target, RIDGE)
    return Model(chosen, w[:-1], float(w[-1]))


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``documents``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s = np.array([shared.value.score(t) for t in column(b, "text").to_pylist()])
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity; see the module for the method."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(documents, labels, training_row(4, 2))
    return score_documents(documents, model).select("doc_id", F.coalesce(~training_row(4, 2), F.lit(False)).alias("held_out"), "score", "predicted")
