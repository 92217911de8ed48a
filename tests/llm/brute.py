"""Plain, slow versions of the operators, written from their contracts."""

import hashlib
import re

import xxhash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def components(fps, bits=2):
    """Of each distinct key of ``fps`` (key to fingerprint) the keys it is joined with, all pairs compared."""
    keys = list(fps)
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                up[root(a)] = root(b)
    groups = {}
    for k in keys:
        groups.setdefault(root(k), []).append(k)
    return groups.values()


def hits(texts, items):
    """Of each text: words, hit words, items, their digest, whether contaminated."""

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in set(map(len, windows)):
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    found |= own
                    hit.update(range(k, k + n))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def secrets(text):
    """Base spans, one pattern at a time."""
    text, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(out)]
