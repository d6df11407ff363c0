"""Token ids in files of independently reset, checksummed, range-coded blocks.

A file holds the ids of a run of documents in ascending id order::

    magic | payload of each block | directory | its length, its CRC | magic

The directory (JSON, zlib) names the id width, every block's offset, length,
number of ids and CRC-32, and the documents' ids and lengths.  A block decodes
alone (see :mod:`.coder`), so a reader can fetch any span of ids by range.
Files are ordered by the ``part`` of the manifest, one row a file; the prefix
sums of its ``ids`` give every document its place in the whole stream.

Texts are tokenised and cut into blocks in Python and coded in the JVM, a slice
of texts at a time; coded blocks are kept as Parquet, and each part of these is
then copied to its file.  So no task runs two Python workers beside a tokenizer.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .coder import BLOCK_IDS, decoded, encoded
from .common import column, delete, open_fs, partitions, shared_path, text_chunks
from .tokenize import encoder

MAGIC = b"VSTOKS02"
#: Text that is tokenised at once: the more, the fewer times a word is looked up.
TEXT_BYTES = 3 << 20
#: Bytes of blocks that are read by one range request.
READ_BYTES = 4 << 20

_BLOCKS = "part int, width int, n int, crc long, ids binary, docs array<long>, lengths array<long>"
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_BLOCK_NAMES = ["part", "width", "n", "crc", "ids", "docs", "lengths"]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _cut(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's stream of ids, and after those of each slice of texts its documents and their lengths."""
    enc = encoder(tokenizer)
    end, held, task = enc.pack([end_id]), np.zeros(0, dtype=enc.dtype), TaskContext.get().partitionId()

    def blocks(ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(ids), 64 * BLOCK_IDS):
            parts = [ids[j : j + BLOCK_IDS] for j in range(k, min(len(ids), k + 64 * BLOCK_IDS), BLOCK_IDS)]
            yield _rows([(task, enc.width, len(p), _crc(p), p.tobytes(), None, None) for p in parts], _BLOCK_NAMES, _BLOCK_TYPES)

    for batch in text_chunks(batches, limit=TEXT_BYTES):
        made = [x + end for x in enc.encode(batch.column("text").to_pylist())]
        lengths = [len(x) // enc.width for x in made]
        ids = np.concatenate([held, np.frombuffer(b"".join(made), dtype=enc.dtype)])
        cut = len(ids) // BLOCK_IDS * BLOCK_IDS
        yield from blocks(ids[:cut])
        held = ids[cut:]
        yield _rows([(task, enc.width, 0, None, None, batch.column("doc_id").to_pylist(), lengths)], _BLOCK_NAMES, _BLOCK_TYPES)
    yield from blocks(held)


def _store(batches: Iterator[pa.RecordBatch], coded: str, path: str) -> Iterator[pa.RecordBatch]:
    """Copy the blocks and documents of each Parquet file named to a file of its own; gives the rows of the manifest."""
    for batch in batches:
        for name in batch.column("name").to_pylist():
            fs, base = open_fs(path)
            fs.create_dir(base, recursive=True)
            made, part, wide, at, total = f"ids-{uuid.uuid4().hex}.vstoks", 0, 2, len(MAGIC), 0
            blocks, docs, sizes = [], [], []
            source, folder = open_fs(coded)
            with source.open_input_file(f"{folder}/{name}") as src, fs.open_output_stream(f"{base}/{made}", compression=None) as out:
                out.write(MAGIC)
                for rows in pq.ParquetFile(src).iter_batches(256):
                    for part, wide, n, crc, data, ids, lengths in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                        if data is None:
                            docs += ids
                            sizes += lengths
                            continue
                        out.write(data)
                        blocks.append([at, len(data), n, crc])
                        at, total = at + len(data), total + n
                tail = zlib.compress(json.dumps({"width": wide, "blocks": blocks, "docs": docs, "lengths": sizes}).encode(), 6)
                out.write(tail + struct.pack("<QI", len(tail), zlib.crc32(tail)) + MAGIC)
            yield _rows([(part, made, len(docs), total)], ["part", "file", "documents", "ids"], [pa.int32(), pa.string(), pa.int64(), pa.int64()])


def directory(f) -> dict:
    """A file's directory, read from its end; damage raises ValueError."""
    size = f.size()
    f.seek(max(0, size - 20))
    end = f.read(20)
    if len(end) < 20 or end[12:] != MAGIC:
        raise ValueError("not a token file")
    length, crc = struct.unpack("<QI", end[:12])
    f.seek(size - 20 - length)
    tail = f.read(length)
    if zlib.crc32(tail) != crc:
        raise ValueError("damaged directory")
    return json.loads(zlib.decompress(tail))


_CODED = "before long, width int, n int, crc long, data binary, docs array<long>, lengths array<long>"
_CODED_TYPES = [pa.int64(), *_BLOCK_TYPES[1:]]
_CODED_NAMES = ["before", "width", "n", "crc", "data", "docs", "lengths"]


def _fetch(batches: Iterator[pa.RecordBatch], path: str, span: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """Of each file its documents, then its blocks, or those alone that hold ids of a span."""
    for batch in batches:
        for name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, base = open_fs(path)
            with fs.open_input_file(f"{base}/{name}") as f:
                d = directory(f)
                yield _rows([(before, d["width"], 0, None, None, d["docs"], d["lengths"])], _CODED_NAMES, _CODED_TYPES)
                starts = before + np.cumsum([0, *(b[2] for b in d["blocks"])])
                want = [k for k in range(len(d["blocks"])) if span is None or (starts[k] < span[1] and starts[k + 1] > span[0])]
                while want:
                    n = 1
                    while n < len(want) and want[n] == want[0] + n and d["blocks"][want[n]][0] - d["blocks"][want[0]][0] < READ_BYTES:
                        n += 1
                    some, want = want[:n], want[n:]
                    first, last = d["blocks"][some[0]], d["blocks"][some[-1]]
                    f.seek(first[0])
                    raw = f.read(last[0] + last[1] - first[0])
                    rows = [(int(starts[k]), d["width"], b[2], b[3], raw[b[0] - first[0] : b[0] - first[0] + b[1]], None, None) for k, b in ((k, d["blocks"][k]) for k in some)]
                    yield _rows(rows, _CODED_NAMES, _CODED_TYPES)


def _checked(data: bytes | None, width: int, n: int, crc: int) -> np.ndarray:
    ids = np.frombuffer(data or b"", dtype="<u2" if width == 2 else "<u4")
    if len(ids) != n or _crc(ids) != crc:
        raise ValueError("damaged block")
    return ids.astype("<u4")


def _documents(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from files' documents and decoded blocks, in their order."""
    names, types = _READ_NAMES[: 4 + with_ids], _READ_TYPES[: 4 + with_ids]
    todo: list[tuple[int | None, int]] = []
    start, parts, have, weight, k = 0, [], 0, 0, 0
    rows: list[tuple] = []

    def whole() -> None:
        """Documents whose ids are all there."""
        nonlocal parts, have, start, k, weight
        ids, at = (np.concatenate(parts) if len(parts) != 1 else parts[0]) if parts else np.zeros(0, dtype="<u4"), 0
        while k < len(todo) and todo[k][1] <= len(ids) - at:
            doc, n = todo[k]
            own = ids[at : at + n]
            rows.append((doc, start, n, zlib.crc32(own.tobytes()), *([own.astype(np.int64)] if with_ids else [])))
            at, start, k = at + n, start + n, k + 1
            weight += 64 + 8 * n * with_ids
        parts, have = [ids[at:]], len(ids) - at

    for batch in batches:
        for before, width, n, crc, data, docs, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if docs is not None:
                todo, k, start, parts, have = list(zip(docs, lengths, strict=True)), 0, before, [], 0
                continue
            parts.append(_checked(data, width, n, crc))
            have += n
            if k < len(todo) and have >= todo[k][1]:
                whole()
            if weight > 1 << 20:
                yield _rows(rows, names, types)
                rows, weight = [], 0
    if rows:
        yield _rows(rows, names, types)


_READ_NAMES = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
_READ_TYPES = [pa.int64()] * 4 + [pa.list_(pa.int64())]


class TokenFiles:
    """Token files and their manifest (part, file, documents, ids) under ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/manifest")

    def _decoded(self, span: tuple[int, int] | None = None) -> DataFrame:
        path = self.path
        placed = self.manifest.select(  # one row a file
            "file", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"), "ids"
        )
        if span:
            placed = placed.where((F.col("before") < span[1]) & (F.col("before") + F.col("ids") > span[0]))
        files = placed.select("file", "before").repartition(partitions(placed), "file")
        coded = files.mapInArrow(lambda it: _fetch(it, path, span), _CODED)
        ids = decoded(self.spark, F.col("data"), F.col("n"), F.col("width"))
        return coded.select("before", "width", "n", "crc", ids.alias("data"), "docs", "lengths")

    def read(self, with_ids: bool = False) -> DataFrame:
        """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files, a task a file.

        Damaged files and blocks raise ValueError.
        """
        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
        return self._decoded().mapInArrow(lambda it: _documents(it, with_ids), schema)

    def span(self, first: int, last: int) -> DataFrame:
        """(start, ids) of the blocks that hold the ids at places ``first`` to ``last`` (exclusive), cut to these; no other block is read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for before, width, n, crc, data, docs, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if docs is None:
                        ids = _checked(data, width, n, crc)
                        rows.append((max(before, first), ids[max(0, first - before) : last - before].astype(np.int64)))
                yield _rows(rows, ["start", "ids"], [pa.int64(), pa.list_(pa.int64())])

        return self._decoded((first, last)).mapInArrow(run, "start long, ids array<long>")


def write(
    docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> TokenFiles:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending id order.

    Rows: a null or empty text is its end id alone; rows without an id come
    first and keep a null id; rows that repeat an id lie side by side, ordered
    by a hash of their texts, and any number of them is dealt to many files;
    an empty table gives no files.  Other columns are not read.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    plain = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    keyed = plain.withColumn("h", F.xxhash64("text"))
    # texts are dealt before they are encoded: sampling for the ranges would encode them twice
    dealt = keyed.repartitionByRange(partitions(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    blocks = dealt.mapInArrow(lambda it: _cut(it, tokenizer, end_id), _BLOCKS)
    width = encoder(tokenizer).width
    coded = blocks.select("part", "width", "n", "crc", encoded(spark, F.col("ids"), width).alias("data"), "docs", "lengths")
    folder = shared_path(spark, "coded")
    coded.write.option("compression", "none").parquet(folder)  # a file a task, in the order of its ids
    fs, base = open_fs(folder)
    names = [(f.base_name,) for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet") and f.size]
    files = spark.createDataFrame(names, "name string").repartition(max(1, len(names)))
    manifest = "part int, file string, documents long, ids long"
    files.mapInArrow(lambda it: _store(it, folder, path), manifest).where("documents > 0").write.parquet(f"{path}/manifest")
    delete(spark, folder)
    return TokenFiles(spark, path)
