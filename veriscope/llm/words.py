"""Vectorised hashes of words and of windows of words over many texts at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1B54A32D192ED03)
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are hashed at once.
PART = 1 << 17
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    return h


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = _U(pow(int(base), -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=_U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[int(base)] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """A polynomial hash of values[s:e] for each span, in constant time a span."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.multiply(values, up[: len(values)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


@dataclass
class Words:
    """Words of several texts.  ``docs[d]:docs[d + 1]`` are the words of text d."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.docs)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.docs) - 1), self.counts)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each window of ``length`` words within a text."""
        n = len(self.hashes)
        if n < length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
        at = np.arange(n - length + 1)
        own = self.owner()
        at = at[own[: n - length + 1] == own[length - 1 :]]
        return at, mix(_spans(self.hashes, at, at + length, _STEP) + _U(length))


def split_words(texts: Sequence[str | None], lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts; a null text has none."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
    if lower:
        buf = _LOWER[buf]
    sep = _SEP[buf]
    edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
    if len(buf) and not sep[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    docs = np.searchsorted(starts, begins)
    hashes = np.empty(len(starts), dtype=_U)
    first = 0
    while first < len(starts):  # eight bytes a byte, so a part at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PART, side="right")))
        s, e = starts[first:last], ends[first:last]
        part = buf[s[0] : e[-1]].astype(_U)
        part += _U(1)
        hashes[first:last] = _spans(part, s - s[0], e - s[0], _BASE)
        first = last
    return Words(buf, starts, ends, docs, mix(hashes + (ends - starts).astype(_U)))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): each text's shingles, repeats included; ``bounds[d]:bounds[d+1]`` are text d's.

    A text of fewer than ``size`` words has its whole sequence as one shingle,
    a text of none has none.
    """
    at, h = w.windows(size)
    own = w.owner()[at] if len(at) else at
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        s, e = w.docs[short], w.docs[short + 1]
        extra = mix(_spans(w.hashes, s, e, _STEP) + (e - s).astype(_U))
        own, h = np.concatenate([own, short]), np.concatenate([h, extra])
        order = np.argsort(own, kind="stable")
        own, h = own[order], h[order]
    return h, np.searchsorted(own, np.arange(len(w.docs)))


def distinct_sets(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text, with bounds as in :func:`shingles`."""
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[keep], own[keep]
    return h, np.searchsorted(own, np.arange(len(bounds)))
