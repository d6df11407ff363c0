"""Plain versions of the operators, row by row, to hold results against."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return WORD.findall(text)


def shingles(w, size=5):
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def near_duplicates(rows, percent):
    """rows: (doc_id, text) with distinct ids; returns id -> (n, component)."""
    sets = {i: frozenset(shingles(words(t, True))) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    post = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            post[x].append(i)
    pairs = Counter((a, b) for p in post.values() for k, a in enumerate(p) for b in p[k + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i, _ in rows}


def remove_repeats(rows, window):
    """rows: (doc_id, text); returns one (doc_id, n, removed, kept words) a row."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), kept))
    return out


def find_items(texts, items, percent=80):
    """(text number, item id) -> best similarity."""
    out = {}
    for d, t in enumerate(texts):
        w = words(t, True)
        for item, text in items:
            v = words(text, True)
            if not v or not w or (len(v) < 5 and len(w) < len(v)):
                continue
            b = Counter(shingles(v))
            n = min(len(v), len(w))
            best = 0
            for k in range(len(w) - n + 1):
                a = Counter(shingles(w[k : k + n]))
                both = sum((a & b).values())
                union = sum(a.values()) + sum(b.values()) - both
                if 100 * both >= percent * union:
                    best = max(best, both / union)
            if best:
                out[d, item] = best
    return out


def top_k(rows, is_query, k, scale):
    v = {}
    for i, x in rows:
        if x is not None and all(c is not None and np.isfinite(c) for c in x):
            v[i] = [int(np.floor(scale * float(np.float64(c)))) for c in x]
    out = []
    for q in v:
        if is_query(q):
            got = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(got[:k])]
    return out


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def digest(kept):
    return sha256(" ".join(kept).encode()).hexdigest()
