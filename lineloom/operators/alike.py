"""Best matches among texts by edit similarity: all pairs, many at a time in the bits of integers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bits of texts that go through one scan.
SCAN = 8192


def distances(patterns: Sequence[str], text: str, plan: tuple) -> np.ndarray:
    """Levenshtein distances of ``text`` to all ``patterns``, for which ``plan`` was made (see :func:`planned`).

    The bits of two integers are the differences down the column of each pattern (Myers, Hyyrö); patterns
    lie side by side with an empty bit after each, which takes up what an addition carries over.
    """
    where, every, low, starts, size = plan
    more, less = every, 0
    for c in text:
        same = where.get(c, 0)
        across = (((same & more) + more ^ more) | same | less) & every
        up, down = less | every ^ (across | more), more & across
        up, down = up << 1 & every | low, down << 1 & every
        more, less = down | every ^ (across | up), up & across
    a, b = (np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little").astype(np.int32) for x in (more, less))
    return len(text) + np.add.reduceat(a - b, starts)


def planned(patterns: Sequence[str]) -> tuple:
    """Where each character stands in ``patterns``, none of which is empty, and their bits, first bits, starts and bytes in all."""
    starts = np.cumsum([0] + [len(p) + 1 for p in patterns])
    size = int(starts[-1]) // 8 + 1
    joined = "\n".join(patterns) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)

    def bits(flags: np.ndarray) -> int:
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    where = {c: bits(codes == ord(c)) for c in set(joined) - {"\n"}}
    inside = np.ones(len(codes), bool)
    inside[starts[1:] - 1] = False
    low = np.zeros(len(codes), bool)
    low[starts[:-1]] = True
    return where, bits(inside), bits(low), starts[:-1], size


def similar_pairs(a: Sequence[str], b: Sequence[str], least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """All pairs of different, non-empty texts that may reach ``least``: ``(i, others, similarities, swapped)``.

    ``i`` is of ``b`` and ``others`` are of ``a``, or the other way round if ``swapped``.  A text that holds the
    other is 0.9 like it.
    """
    a, b = (([i for i in sorted(range(len(x)), key=lambda i: len(x[i])) if x[i]], x) for x in (a, b))
    # The shorter side is scanned, the longer one lies in the bits.
    swapped = sum(len(a[1][i]) for i in a[0]) < sum(len(b[1][i]) for i in b[0])
    (many, p), (scanned, t) = (b, a) if swapped else (a, b)
    at = 0
    while at < len(many):
        end, bits = at, 0
        while end < len(many) and (end == at or bits + len(p[many[end]]) < SCAN):
            bits += len(p[many[end]]) + 1
            end += 1
        chunk = many[at:end]
        texts = [p[i] for i in chunk]
        index, length = np.array(chunk), np.array([len(x) for x in texts])
        plan = None
        for j in scanned:
            x = t[j]
            if len(x) < least * length[0] - 1e-9 or length[-1] < least * len(x) - 1e-9:
                # Lengths too far apart for any distance; one may still hold the other.
                held = np.array([k for k, u in enumerate(texts) if (u in x if len(u) < len(x) else x in u)], int)
                if len(held):
                    yield j, index[held], np.full(len(held), 0.9), swapped
                continue
            plan = plan or planned(texts)
            d = distances(texts, x, plan)
            longer = np.maximum(length, len(x))
            s = 1.0 - d / longer
            # Where one may hold the other, the distance is what it is longer.
            for k in np.flatnonzero(d == np.abs(length - len(x))):
                if texts[k] != x and (texts[k] in x or x in texts[k]):
                    s[k] = 0.9
            yield j, index, s, swapped
        at = end


class Best:
    """The best match so far of each of ``n`` texts: similarity, and the rank of the match, smaller first on ties."""

    def __init__(self, n: int) -> None:
        self.similarity = np.zeros(n)
        self.rank = np.zeros(n, int)

    def offer(self, to: np.ndarray, similarity: np.ndarray, rank: int) -> None:
        better = (similarity > self.similarity[to]) | ((similarity == self.similarity[to]) & (rank < self.rank[to]))
        self.similarity[to[better]], self.rank[to[better]] = similarity[better], rank

    def offer_all(self, to: int, similarity: np.ndarray, ranks: np.ndarray) -> None:
        top = similarity.max()
        rank = ranks[similarity == top].min()
        if top > self.similarity[to] or (top == self.similarity[to] and rank < self.rank[to]):
            self.similarity[to], self.rank[to] = top, rank


def best_matches(a: Sequence[str], b: Sequence[str], least: float, both: bool = False) -> tuple[Best, Best]:
    """For each of the distinct texts ``a`` the best of the distinct texts ``b``, ranked by place; with ``both``, of ``b`` in ``a`` too.

    Equal texts are 1 alike, an empty one is 0 like any other.
    """
    of_a, of_b = Best(len(a)), Best(len(b))
    place = {x: i for i, x in enumerate(b)}
    new_a, new_b = [], []
    for i, x in enumerate(a):
        k = place.pop(x, None)
        if k is None:
            new_a.append(i)
        else:
            of_a.similarity[i], of_a.rank[i] = 1.0, k
            of_b.similarity[k], of_b.rank[k] = 1.0, i
    new_b = sorted(place.values())

    def meet(x: Sequence[int], y: Sequence[int]) -> None:
        """Texts ``x`` of ``a`` with ``y`` of ``b``."""
        for i, others, s, swapped in similar_pairs([a[i] for i in x], [b[i] for i in y], least):
            # ``i`` is of b and ``others`` of a, or the other way round.
            one, many = (of_a, of_b) if swapped else (of_b, of_a)
            i, others = (x[i], ys[others]) if swapped else (y[i], xs[others])
            many.offer(others, s, i)
            one.offer_all(i, s, others)

    xs, ys = np.array(new_a, int), np.arange(len(b))
    if new_a and len(b):
        meet(new_a, range(len(b)))
    if both and new_b:
        # What is new in a has met them already.
        old = [i for i in range(len(a)) if of_a.similarity[i] == 1.0]
        xs, ys = np.array(old, int), np.array(new_b, int)
        if old:
            meet(old, new_b)
    return of_a, of_b
