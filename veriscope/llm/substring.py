"""Substring deduplication by level-wise doubling of repeated word windows.

A window of ``window`` words can repeat only if every shorter window in it
does.  Lengths double from a few words up to ``window`` (4, 7 and 13 words).
At each length one shorter window of every live full window, that of least
hash in it (the same wherever the full window stands), is looked up over all
documents; where it stands in one document alone, the full window is dead.
What lives is looked at again at twice the length, until the full length is
reached or no candidate survives.  At full length the windows left are compared
by the smallest document each starts in.  Longer repeats are unions of full
windows, so levels beyond ``window`` would remove no other word.

Texts lie in groups of about two megabytes, which are written once and never
move.  A group sends each bucket of hashes the distinct keys that it has there,
however often they occur in the group: four bytes each below the full length,
where a chance collision costs a look and no more.  It is sent back a bit a
key.  So a passage that a third of all documents share is one key a group, and
no task holds more than a bucket or a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .common import Scratch, carried, column, open_fs, partitions, restored, runs, shared_path, text_chunks, with_fields
from .words import Words, split_words

WINDOW = 13
#: Words of a passage that a corpus should hold once.
PASSAGE = 50
#: No level has fewer words.
SHORTEST = 4
#: Bytes of text whose hashes make one bucket; bytes of text of a group.
BUCKET_BYTES, GROUP_BYTES = 16 << 20, 2 << 20
_U = np.uint64
_HALF = _U(32)


def levels(window: int) -> list[int]:
    """The lengths that are looked at: each at most twice the one before, the last is ``window``."""
    out = [window]
    while (half := (out[0] + 1) // 2) >= SHORTEST and half < out[0]:
        out.insert(0, half)
    return out


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _groups(docs: DataFrame) -> DataFrame:
    """(part, gid, payload): rows of ``docs`` in groups, each an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, batch in enumerate(text_chunks(batches, "text", GROUP_BYTES)):
            cols = [pa.array([part], pa.int32()), pa.array([(part << 32) + i]), pa.array([_pack(batch)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "gid", "payload"])

    return docs.mapInArrow(run, "part int, gid long, payload binary")


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of ``values[i : i + span]`` for each i that has so many."""
    have, width = values, 1
    while 2 * width <= span:
        have = np.minimum(have[: len(have) - width], have[width:])
        width *= 2
    if width < span:
        have = np.minimum(have[: len(have) - (span - width)], have[span - width :])
    return have


class _Group:
    """The full windows of a group that may still be repeats: ``at`` their first words, ``h`` their hashes."""

    def __init__(self, payload: bytes, window: int, buckets: int) -> None:
        self.batch = pa.ipc.open_stream(payload).read_next_batch()
        self.words = split_words(self.batch.column("text").to_pylist())
        ids = self.batch.column("id")
        own = self.words.owner()
        self.doc = ids.fill_null(0).to_numpy(zero_copy_only=False)[own]
        at, h = self.words.windows(window)
        known = ~ids.is_null().to_numpy(zero_copy_only=False)[own[at]]
        self.at, self.h, self.window, self.buckets = at[known], h[known], window, _U(buckets)

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of the window of ``length`` words of least hash in each live full window, the leftmost of equals."""
        at, h = self.words.windows(length)
        bits = _U(max(16, len(self.words.hashes).bit_length()))
        dense = np.full(len(self.words.hashes), np.iinfo(np.uint64).max, dtype=_U)
        dense[at] = (h >> bits << bits) | at.astype(_U)
        place = (sliding_least(dense, self.window - length + 1)[self.at] & ((_U(1) << bits) - _U(1))).astype(np.int64)
        dense[at] = h
        return place, dense[place]

    def keys(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each live window's key, the distinct keys, whether several documents of the group have each).

        A key is a bucket and 32 bits more of the hash.
        """
        if not len(self.at):
            return self.at, np.zeros(0, dtype=_U), np.zeros(0, dtype=bool)
        place, h = self.anchors(length)
        key = ((h % self.buckets) << _HALF) | ((h // self.buckets) & _U(0xFFFFFFFF))
        distinct, number = np.unique(key, return_inverse=True)
        least, most = _extremes(number, self.doc[place], len(distinct))
        return number, distinct, least != most

    def narrow(self, length: int, back: dict[int, bytes]) -> None:
        """Leave the windows whose anchor is found to repeat."""
        number, distinct, _ = self.keys(length)
        live = _bits((distinct >> _HALF).astype(np.int64), back)[number]
        self.at, self.h = self.at[live], self.h[live]

    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of each live window's hash, buckets, distinct hashes, the least document of each), by bucket and hash."""
        h, number = np.unique(self.h, return_inverse=True)
        least, _ = _extremes(number, self.doc[self.at], len(h))
        bucket = (h % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return rank[number], bucket[order], h[order], least[order]


def _extremes(number: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest document of each of ``n`` numbers."""
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(number, kind="stable")
    first = np.searchsorted(number[order], np.arange(n))
    return np.minimum.reduceat(doc[order], first), np.maximum.reduceat(doc[order], first)


def _slices(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run of a sorted array."""
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
    return list(zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(bucket)).tolist(), strict=True)) if len(first) else []


def _bits(bucket: np.ndarray, back: dict[int, bytes]) -> np.ndarray:
    """What came back for the keys of sorted buckets; nothing came back for a bucket without a repeat."""
    out = np.zeros(len(bucket), dtype=bool)
    for b, s, e in _slices(bucket):
        if b in back:
            out[s:e] = np.unpackbits(np.frombuffer(back[b], dtype=np.uint8), count=e - s)
    return out


class _Back:
    """What buckets sent back, a folder for each part of the groups; a task reads those of its parts."""

    def __init__(self, root: str) -> None:
        self.root, self.part = root, None
        self.by: dict[int, dict[int, bytes]] = {}

    def of(self, part: int, gid: int) -> dict[int, bytes]:
        if part != self.part:
            self.part, self.by = part, {}
            fs, base = open_fs(self.root)
            for f in fs.get_file_info(pafs.FileSelector(f"{base}/part={part}", allow_not_found=True)):
                if f.path.endswith(".parquet"):
                    with fs.open_input_file(f.path) as src:
                        got = pq.read_table(src)
                    for g, b, bits in zip(*(got.column(c).to_pylist() for c in ("gid", "bucket", "bits")), strict=True):
                        self.by.setdefault(g, {})[b] = bits
        return self.by.get(gid, {})


def _live(batches: Iterator[pa.RecordBatch], window: int, buckets: int, done: list[tuple[int, str]]) -> Iterator[tuple[int, int, _Group]]:
    """(part, gid, group) with the windows that the levels ``done`` (length, what came back) have left."""
    backs = [(length, _Back(root)) for length, root in done]
    for batch in batches:
        for part, gid, payload in zip(*(batch.column(c) for c in ("part", "gid", "payload")), strict=True):
            part, gid = part.as_py(), gid.as_py()
            group = _Group(payload.as_py(), window, buckets)
            for length, back in backs:
                group.narrow(length, back.of(part, gid))
            yield part, gid, group


def _answer(dealt: DataFrame, verdict, root: str) -> bool:
    """Deal rows to their buckets and write a bit a key to ``root``; false if no bit is set.

    ``verdict`` gives, for the rows of a bucket, the bits of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["bucket"]):
            bits = verdict(rows)
            some = [i for i, b in enumerate(bits) if b.any()]
            cols = [rows.column(c).take(pa.array(some, pa.int64())) for c in ("part", "gid", "bucket")]
            cols.append(pa.array([np.packbits(bits[i]).tobytes() for i in some], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["part", "gid", "bucket", "bits"])

    p = partitions(dealt)
    back = dealt.repartition(p, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "part int, gid long, bucket long, bits binary")
    back.repartition(p, "part").write.partitionBy("part").parquet(root)
    fields = "gid long, bucket long, bits binary, part int"
    return not dealt.sparkSession.read.schema(fields).parquet(root).isEmpty()


def _several(rows: pa.RecordBatch) -> list[np.ndarray]:
    """Keys that two groups have, or two documents of one."""
    keys = [np.frombuffer(x, dtype="<u4") for x in rows.column("keys").to_pylist()]
    many = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)) for x, k in zip(rows.column("many").to_pylist(), keys, strict=True)]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    times = np.bincount(number, minlength=len(distinct)) + np.bincount(number, weights=np.concatenate(many), minlength=len(distinct))
    return np.split(times[number] > 1, np.cumsum([len(k) for k in keys])[:-1])


def _smaller(rows: pa.RecordBatch) -> list[np.ndarray]:
    """Hashes that a document smaller than any of the group's has."""
    hs = [np.frombuffer(x, dtype="<u8") for x in rows.column("keys").to_pylist()]
    lows = [
        np.frombuffer(x, dtype="<u4" if len(x) == 4 * len(h) else "<i8").astype(np.int64) + base
        for h, x, base in zip(hs, rows.column("low").to_pylist(), rows.column("base").to_pylist(), strict=True)
    ]
    doc = np.concatenate(lows)
    distinct, number = np.unique(np.concatenate(hs), return_inverse=True)
    least, _ = _extremes(number, doc, len(distinct))
    return np.split(least[number] < doc, np.cumsum([len(h) for h in hs])[:-1])


def _rows(part: int, gid: int, cut: list[tuple[int, int, int]], more: dict[str, pa.Array]) -> pa.RecordBatch:
    n = len(cut)
    cols = [pa.array([part] * n, pa.int32()), pa.array([gid] * n, pa.int64()), pa.array([b for b, _, _ in cut], pa.int64()), *more.values()]
    return pa.RecordBatch.from_arrays(cols, names=["part", "gid", "bucket", *more])


def repeats(groups: DataFrame, window: int, buckets: int) -> list[tuple[int, str]] | None:
    """(length, folder of bits) of each level, or none if no window survives some level."""
    done: list[tuple[int, str]] = []

    def short(length: int, before: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, gid, group in _live(batches, window, buckets, before):
                _, keys, many = group.keys(length)
                cut, low = _slices((keys >> _HALF).astype(np.int64)), keys.astype("<u4")
                made = {"keys": pa.array([low[s:e].tobytes() for _, s, e in cut], pa.binary()), "many": pa.array([np.packbits(many[s:e]).tobytes() for _, s, e in cut], pa.binary())}
                yield _rows(part, gid, cut, made)

        return run

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, gid, group in _live(batches, window, buckets, done):
            _, bucket, h, least = group.full()
            cut, base = _slices(bucket), int(least.min(initial=np.iinfo(np.int64).max))
            wide = len(least) and int(least.max()) - base >= 1 << 32
            low = least if wide else (least - base).astype("<u4")
            made = {
                "keys": pa.array([h[s:e].tobytes() for _, s, e in cut], pa.binary()),
                "low": pa.array([low[s:e].tobytes() for _, s, e in cut], pa.binary()),
                "base": pa.array([0 if wide else base] * len(cut), pa.int64()),
            }
            yield _rows(part, gid, cut, made)

    head = "part int, gid long, bucket long, keys binary, "
    for length in levels(window):
        root = shared_path(groups.sparkSession, f"repeats-{length}")
        if length < window:
            found = _answer(groups.mapInArrow(short(length, list(done)), head + "many binary"), _several, root)
        else:
            found = _answer(groups.mapInArrow(full, head + "low binary, base long"), _smaller, root)
        done.append((length, root))
        if not found and length < window:
            return None
    return done


def _cut(w: Words, gone: np.ndarray, joined: bool, whole: list[str | None]) -> list[str | None]:
    """Each text without the words in ``gone``."""
    keep = np.zeros(len(w.buf) + 1, dtype=np.int8)
    kept = ~gone
    # a kept word and what follows it: one space if joined, else its own white space
    after = np.append(w.starts[1:], len(w.buf)) if len(w.starts) else w.starts
    ends = w.ends + 1 if joined else after
    np.add.at(keep, w.starts[kept], 1)
    np.add.at(keep, ends[kept], -1)
    mask = np.cumsum(keep[:-1], dtype=np.int8) > 0
    buf = w.buf.copy()
    if joined:
        buf[w.ends] = 0x20
    out = buf[mask].tobytes()
    sizes = np.append(0, np.cumsum((ends - w.starts) * kept))
    cuts = sizes[w.docs].tolist()
    lost = np.append(0, np.cumsum(gone))[w.docs]
    texts: list[str | None] = []
    for d, t in enumerate(whole):
        if not joined and lost[d + 1] == lost[d]:
            texts.append(t)
        else:
            texts.append(out[cuts[d] : cuts[d + 1]].decode("utf-8", "surrogatepass").rstrip(" \t\n\x0b\x0c\r"))
    return texts


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", joined: bool = False
) -> DataFrame:
    """``docs`` with ``text_col`` cut, and two columns more: ``n_words`` and ``n_removed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if it is covered
    by a window of ``window`` words whose sequence also starts in a document of
    smaller id.  Windows are judged on the input.  A text that loses nothing
    stays as it is; of another, each kept word keeps the white space after it.
    With ``joined``, kept words are joined by one space in all texts.

    Rows: a null text has no words and stays null (empty if joined); texts
    shorter than a window lose nothing; of rows that repeat an id neither
    counts as smaller; rows without an id lose nothing and take nothing from
    others.  All other columns are carried along, whatever their names; a
    column already named ``n_words`` or ``n_removed`` is replaced.
    """
    if window < 1:
        raise ValueError("a window has one word or more")
    names, cols = carried(docs, id_col, text_col, "n_words", "n_removed")
    plain = docs.select(*cols, column(id_col).cast("long").alias("id"), column(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length(column(text_col).cast("string")))).first()[0] or 0
    buckets = max(partitions(docs), -(-size // BUCKET_BYTES))
    groups = Scratch(docs.sparkSession).keep(_groups(plain), "substring", "none")
    done = repeats(groups, window, buckets)
    schema = with_fields(plain, StructField("n", LongType()), StructField("lost", LongType()))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _Back(done[-1][1]) if done else None
        for part, gid, group in _live(batches, window, buckets, done[:-1] if done else []):
            w = group.words
            lost = np.zeros(len(w.hashes), dtype=bool)
            if last and len(group.at):
                number, bucket, _, least = group.full()
                gone = _bits(bucket, last.of(part, gid))[number] | (least[number] < group.doc[group.at])
                edge = np.zeros(len(w.hashes) + 1, dtype=np.int32)
                np.add.at(edge, group.at[gone], 1)
                np.add.at(edge, group.at[gone] + window, -1)
                lost = np.cumsum(edge[:-1]) > 0
            texts = _cut(w, lost, joined, group.batch.column("text").to_pylist())
            n_lost = np.diff(np.append(0, np.cumsum(lost))[w.docs])
            new = [pa.array(texts, pa.string()), pa.array(w.counts.astype(np.int64)), pa.array(n_lost.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*group.batch.columns[:-1], *new], names=[*group.batch.schema.names, "n", "lost"])

    made = groups.mapInArrow(finish, schema)
    back = dict(zip(names, restored(names), strict=True)) | {id_col: F.col("id").alias(id_col), text_col: F.col("text").alias(text_col)}
    return made.select(*[back[c] for c in docs.columns if c in back], F.col("n").alias("n_words"), F.col("lost").alias("n_removed"))
