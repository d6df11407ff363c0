"""Concatenate-and-cut packing of documents into fixed token windows.

Two passes.  The first tokenises every document once, where it is read, and
writes its ids with its place in the partition; the sum of each partition's
tokens, summed up over partitions, gives every document its place in the one
long stream.  The second cuts the stream at multiples of the window.  Only the
last window can be short, so there is next to no padding.

Rows: a null or empty text is one end id; repeated ids and repeated rows are
separate documents; an empty table gives no pieces.  Columns besides the two
named are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, materialise, text_chunks
from .tokenize import encoder

WINDOW = 1024
TOKENS = "part int, base long, doc_id long, n long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, sequence_tokens long"
)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of whole texts with the end id, and their place in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end, part, base = enc.pack([end_id]), TaskContext.get().partitionId(), 0
        for batch in text_chunks(batches):
            ids = [x + end for x in enc.encode(batch.column("text").to_pylist())]
            n = np.fromiter((len(x) // enc.width for x in ids), dtype=np.int64, count=len(ids))
            at = base + np.cumsum(n) - n
            base += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(at), batch.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())],
                names=["part", "base", "doc_id", "n", "ids"],
            )

    plain = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return plain.mapInArrow(run, TOKENS)


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """(part, before, total): prefix sums over partitions; one row a partition of the input."""
    sums = tokens.groupBy("part").agg(F.sum("n").alias("tokens"))
    return sums.select(
        "part",
        (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before"),
        F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document that lies in one window.

    ``start`` counts the document's ids before the piece, ``offset`` is its
    place in the window, ``sequence_tokens`` the ids that the window holds.
    With ``with_ids`` the piece's ids follow as ``ids``; :func:`sequences`
    builds the windows from them.
    """
    tokens = materialise(token_table(docs, tokenizer, end_id, id_col, text_col), "pack")
    # one row a partition: far below any limit of a broadcast
    placed = tokens.join(F.broadcast(partition_offsets(tokens)), "part").select(
        "doc_id", "n", (F.col("base") + F.col("before")).alias("at"), "total", "ids"
    )
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            docs_, ns, ats = (batch.column(k).to_pylist() for k in ("doc_id", "n", "at"))
            raw = batch.column("ids")
            for i, (doc, n, at, total) in enumerate(zip(docs_, ns, ats, batch.column("total").to_pylist(), strict=True)):
                data = raw[i].as_py()
                ids = np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(at + start, window)
                    length = min(n - start, window - off)
                    piece = ids[start : start + length]
                    row = (doc, start, length, zlib.crc32(piece.tobytes()), n, seq, off, min(window, total - seq * window), piece)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                    start += length
            cols = [pa.array(c, pa.int64()) for c in out[:8]]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                cols.append(pa.array([p.astype(np.int32) for p in out[8]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole windows (sequence_id, ids, boundaries) from pieces with ids.

    ``boundaries`` lists (offset, doc_id, start) of each piece.  A group is at
    most ``window`` pieces.  The last window is padded, except where its
    length is a power of two.
    """
    got = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("p"), F.first("sequence_tokens").alias("n")
    )
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    exact = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    pad = F.when(exact, F.lit(0)).otherwise(F.lit(window) - F.col("n")).cast("int")
    return got.select(
        "sequence_id",
        F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias("ids"),
        F.transform("p", lambda x: F.struct(x["offset"], x["doc_id"], x["start"])).alias("boundaries"),
    )
