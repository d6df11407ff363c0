"""Benchmark decontamination by SimHash of item-sized windows.

Each benchmark item of n words is looked for in windows of n words.  A window
and an item have a SimHash of their 5-word shingles, in which the k-th
occurrence of a shingle is a feature of its own, so that the angle depends on
the weighted Jaccard similarity however often a shingle repeats.  Fingerprints meet in a multi-index: they are cut into blocks,
and two within ``RADIUS`` bits must be within ``BLOCK_RADIUS`` bits in one of
the blocks, so the union of the blocks' lists holds all fingerprints within
the radius.  Pairs within it are verified by the exact weighted Jaccard
similarity of their shingles.

A window without a single shingle of an item of its size has similarity 0 and
gets no fingerprint.  Items are fingerprinted in tasks and written to the shared
folder in slices of a bounded size, which tasks load; a benchmark of several
slices takes as many passes over the documents.  No item reaches the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, column, open_fs, restored, runs, shared_path, text_chunks, unused, with_fields
from .words import Words, mix, shingles, split_words

PERCENT = 80
#: A pair at 80 % differs in 39 of 256 bits, give or take 5.7; the radius lies four deviations above.
BITS, BLOCK, RADIUS, BLOCK_RADIUS = 256, 16, 63, 3
#: Bits of ``BLOCK_RADIUS`` that the lists hold for each item; the window looks up the others.
ITEM_RADIUS = 2
#: Items of a slice, and their words.
SLICE_ITEMS, SLICE_WORDS = 4000, 1_000_000
#: Text that is searched at once.
SLICE_BYTES = 1 << 20
_U = np.uint64
_WINDOWS = 8192
_BUILT: dict[str, Index] = {}


def _bit_rows(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    words = np.stack([mix(h + _U(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(BITS // 64)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(h), BITS // 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _features(h: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The feature of the k-th occurrence (from 1) of each shingle."""
    return np.where(k > 1, mix(h + k.astype(_U) * _U(0xA0761D6478BD642F)), h)


def _occurrences(h: np.ndarray, run: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entering, leaving): of each place, its shingle's number in the window that ends there, and in the one that starts there.

    ``run`` numbers the stretches that no window crosses; ``length`` is their windows' length.
    """
    n = len(h)
    at = np.arange(n)
    first, last = np.searchsorted(run, run), np.searchsorted(run, run, side="right") - 1
    order = np.argsort(h, kind="stable")
    group = np.zeros(n, dtype=np.int64)
    group[order[1:]] = np.cumsum(h[order[1:]] != h[order[:-1]])
    key, place = group[order] * n + order, np.zeros(n, dtype=np.int64)
    place[order] = at
    entering = place - np.searchsorted(key, group * n + np.maximum(first, at - length + 1)) + 1
    leaving = np.searchsorted(key, group * n + np.minimum(last, at + length - 1), side="right") - place
    return entering, leaving


def window_sums(h: np.ndarray, run: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bit sums of the features of the windows that start at the places ``at``.

    A window one place on gains the last occurrence of the shingle that enters
    and loses the last one of that which leaves.
    """
    entering, leaving = _occurrences(h, run, length)
    rows = _bit_rows(_features(h, entering))
    gained = np.zeros((len(h) + 1, BITS), dtype=np.int32)
    np.cumsum(rows, axis=0, out=gained[1:])
    other = entering != leaving
    if not other.any():
        return gained[at + length[at]] - gained[at]
    rows[other] = _bit_rows(_features(h[other], leaving[other]))
    lost = np.zeros((len(h) + 1, BITS), dtype=np.int32)
    np.cumsum(rows, axis=0, out=lost[1:])
    start = np.searchsorted(run, run[at])
    return gained[at + length[at]] - lost[at] - (gained[start] - lost[start])


def _masks(radius: int) -> np.ndarray:
    """All values of a block with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BLOCK), r)], dtype=np.int64)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Blocks of the SimHash of each row of bit sums."""
    return np.packbits(sums > 0, axis=1).view(">u2").astype(np.int64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


@dataclass
class Item:
    item_id: int
    words: int
    shingles: np.ndarray
    counts: np.ndarray
    size: int
    print: np.ndarray


@dataclass
class Index:
    """Items by number of words; of each size, its shingles and the blocks' lists."""

    items: list[Item]
    sizes: dict[int, np.ndarray] = field(default_factory=dict)
    own: dict[int, np.ndarray] = field(default_factory=dict)
    blocks: dict[int, np.ndarray] = field(default_factory=dict)

    def build(self) -> Index:
        item_masks = _masks(ITEM_RADIUS)
        self.query_masks = _masks(BLOCK_RADIUS - ITEM_RADIUS)
        every = [x.shingles for x in self.items]
        self.all = np.unique(np.concatenate(every)) if every else np.zeros(0, dtype=_U)
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.all >> _U(44)).astype(np.int64)] = True
        by: dict[int, list[int]] = {}
        for i, x in enumerate(self.items):
            by.setdefault(x.words, []).append(i)
        n_blocks = BITS // BLOCK
        for size, group in by.items():
            self.sizes[size] = np.array(group)
            self.own[size] = np.unique(np.concatenate([self.items[i].shingles for i in group]))
            prints = np.stack([self.items[i].print for i in group])
            near = prints[:, :, None] ^ item_masks
            key = (near + (np.arange(n_blocks) << BLOCK)[None, :, None]) << 24
            self.blocks[size] = np.sort((key + np.arange(len(group))[:, None, None]).ravel())
        return self

    def candidates(self, size: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item of the size) within ``RADIUS``: the blocks' lists, then the whole distance."""
        table, group = self.blocks[size], self.sizes[size]
        found: list[np.ndarray] = []
        for block in range(prints.shape[1]):
            for k in range(0, len(prints), max(1, 65536 // len(self.query_masks))):
                part = prints[k : k + max(1, 65536 // len(self.query_masks)), block]
                value = ((part[:, None] ^ self.query_masks) + (block << BLOCK)) << 24
                lo, hi = np.searchsorted(table, value.ravel()), np.searchsorted(table, value.ravel() + (1 << 24))
                n = hi - lo
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                window = np.repeat(np.repeat(np.arange(k, k + len(part)), len(self.query_masks)), n)
                found.append(np.unique((window << 24) + (table[at] & 0xFFFFFF)))
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        window, item = both >> 24, group[both & 0xFFFFFF]
        if len(window):
            near = distance(prints[window], np.stack([self.items[i].print for i in group])[both & 0xFFFFFF]) <= RADIUS
            window, item = window[near], item[near]
        return window, item


def make_items(rows: list[tuple[int, str | None]]) -> list[Item]:
    """Items with a word; others can be in no text."""
    out = []
    for item_id, text in rows:
        w = split_words([text], lower=True)
        if not len(w.hashes) or item_id is None:
            continue
        h, _ = shingles(w)
        distinct, counts = np.unique(h, return_counts=True)
        nth = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        sums = _bit_rows(_features(np.repeat(distinct, counts), nth)).sum(axis=0, dtype=np.int64)[None]
        out.append(Item(item_id, len(w.hashes), distinct, counts, len(h), fingerprints(sums)[0]))
    return out


def _in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), dtype=bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def search(index: Index, texts: list[str | None], percent: int = PERCENT) -> list[list[dict]]:
    """For each text the items found in it, by item: best window, the first of equals."""
    w: Words = split_words(texts, lower=True)
    h, bounds = shingles(w)
    hits: list[dict[int, tuple]] = [{} for _ in texts]
    for size in (n for n in index.sizes if n < 5):
        at, short = w.windows(size)
        own = w.owner()
        for k in np.flatnonzero(_in(short, index.own[size])).tolist():
            d, start = int(own[at[k]]), int(at[k] - w.docs[own[at[k]]])
            for i in index.sizes[size].tolist():
                item = index.items[i]
                if item.shingles[0] == short[k]:
                    hits[d].setdefault(item.item_id, ((1.0, -start), {"item_id": item.item_id, "similarity": 1.0, "start": start, "n_words": size}))
    maybe = np.flatnonzero(index.sieve[(h >> _U(44)).astype(np.int64)])
    maybe = maybe[_in(h[maybe], index.all)]
    doc_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    n_shingles = np.diff(bounds)
    for size in (n for n in index.sizes if n >= 5):
        anchor = maybe[_in(h[maybe], index.own[size])]
        if not len(anchor):
            continue
        doc = doc_of[anchor]
        # a window has as many shingles as an item of the size has, or all of a shorter text
        span = np.minimum(size - 4, n_shingles[doc])
        first = np.maximum(bounds[doc], anchor - span + 1)
        last = np.minimum(anchor, bounds[doc] + n_shingles[doc] - span)
        edge = np.zeros(len(h) + 1, dtype=np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, last + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        for k in range(0, len(starts), _WINDOWS):
            part = starts[k : k + _WINDOWS]
            length = np.minimum(size - 4, n_shingles[doc_of[part]])
            edge = np.zeros(part[-1] + length[-1] - part[0] + 1, dtype=np.int32)
            np.add.at(edge, part - part[0], 1)
            np.add.at(edge, part + length - part[0], -1)
            need = np.flatnonzero(np.cumsum(edge[:-1]) > 0) + part[0]
            run = np.zeros(len(need), dtype=np.int64)
            np.cumsum((np.diff(need) > 1) | (np.diff(doc_of[need]) > 0), out=run[1:])
            sums = window_sums(h[need], run, np.minimum(size - 4, n_shingles[doc_of[need]]), np.searchsorted(need, part))
            window, item = index.candidates(size, fingerprints(sums))
            for i in np.unique(item).tolist():
                mine = window[item == i]
                _verify(index.items[i], h, part[mine], length[mine], doc_of, bounds, hits, percent)
    return [[v[1] for _, v in sorted(x.items())] for x in hits]


def _verify(item: Item, h: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc_of: np.ndarray, bounds: np.ndarray, hits: list, percent: int) -> None:
    """Exact weighted Jaccard similarity of windows with an item."""
    n = np.arange(len(starts))
    row = np.repeat(n, lengths)
    flat = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    place = np.minimum(np.searchsorted(item.shingles, h[flat]), len(item.shingles) - 1)
    same = item.shingles[place] == h[flat]
    have = np.zeros((len(starts), len(item.shingles)), dtype=np.int64)
    np.add.at(have, (row[same], place[same]), 1)
    both = np.minimum(have, item.counts[None]).sum(axis=1)
    union = lengths + item.size - both
    for k in np.flatnonzero(100 * both >= percent * union).tolist():
        d, sim = int(doc_of[starts[k]]), float(both[k] / union[k])
        start = int(starts[k] - bounds[d])
        if item.item_id not in hits[d] or (sim, -start) > hits[d][item.item_id][0]:
            hits[d][item.item_id] = ((sim, -start), {"item_id": item.item_id, "similarity": sim, "start": start, "n_words": item.words})


_HIT = "array<struct<item_id: bigint, similarity: double, start: bigint, n_words: bigint>>"
_HIT_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int64()), ("n_words", pa.int64())]))


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[str, int]:
    """(folder, number) of slices of items, each a pickled list; copies of an item once."""
    plain = benchmark.select(column(id_col).cast("long").alias("item"), column(text_col).cast("string").alias("text"))
    plain = plain.where("item is not null and text is not null").distinct()
    count, size = plain.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(-(-count // SLICE_ITEMS), -(-(size or 0) // (6 * SLICE_WORDS)))
    root = shared_path(benchmark.sparkSession, "benchmark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["slice"]):
            items = make_items(list(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([rows.column("slice").slice(0, 1), pa.array([pickle.dumps(items)], pa.binary())], names=["slice", "items"])

    if n:
        dealt = plain.withColumn("slice", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition(n, "slice").sortWithinPartitions("slice", "item", "text")
        dealt.mapInArrow(run, "slice long, items binary").write.partitionBy("slice").parquet(root)
    return root, n


def _index(root: str, k: int) -> Index:
    """The index of a slice; a worker keeps the last one."""
    key = f"{root}/slice={k}"
    if key not in _BUILT:
        _BUILT.clear()
        fs, base = open_fs(root)
        items: list[Item] = []
        for f in fs.get_file_info(pafs.FileSelector(f"{base}/slice={k}", allow_not_found=True)):
            if f.path.endswith(".parquet"):
                with fs.open_input_file(f.path) as src:
                    for blob in pq.read_table(src, columns=["items"]).column("items").to_pylist():
                        items += pickle.loads(blob)
        _BUILT[key] = Index(items).build()
    return _BUILT[key]


def find(
    docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "item_id", text_col: str = "text", hits_col: str = "hits"
) -> DataFrame:
    """``docs`` with ``hits``: items whose similarity to a window is ``percent`` or more.

    Words are ``[^\\x20\\x09-\\x0D]+`` in A-Z lower case.  A hit names the item,
    the weighted Jaccard similarity of the best window (the first of equals),
    its first word and the item's number of words.  A text shorter than an item
    is one window.  Items of fewer than five words are one shingle and are found
    wherever their words stand.

    Rows: null, empty and blank texts have no hits, nor have items without
    text or id; repeated rows are judged each; an empty benchmark gives no
    hits.  A column that bears the name of ``hits_col`` is replaced.
    """
    names, cols = carried(docs, hits_col)
    out = docs.select(*cols, column(text_col).cast("string").alias("text"), F.lit(None).cast(_HIT).alias("hits"))
    root, n = _slices(benchmark, id_col, text_col)
    for k in range(n):

        def run(batches: Iterator[pa.RecordBatch], k: int = k) -> Iterator[pa.RecordBatch]:
            for batch in text_chunks(batches, limit=SLICE_BYTES):
                found = search(_index(root, k), batch.column("text").to_pylist(), percent)
                before = batch.column("hits").to_pylist()
                both = [(a or []) + b for a, b in zip(before, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(both, _HIT_ARROW)], names=batch.schema.names)

        out = out.mapInArrow(run, with_fields(out))
    hits = F.array_sort(F.coalesce("hits", F.array().cast(_HIT)))
    return out.select(*restored(names), hits.alias(hits_col))


def pairs(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): a row a document row and item found in it."""
    found = find(docs.select(column(id_col).alias("doc_id"), "text"), benchmark, percent)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    found = unused("found", docs.columns)
    return find(docs, benchmark, percent, hits_col=found).where(F.size(found) == 0).drop(found)
