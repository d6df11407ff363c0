"""Shared plumbing: the shared folder, materialisation, Arrow batching."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

LOCAL_DIR = "/tmp/checkpoints/veriscope"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where neither the session nor the context has one, a local session (one
    machine, as in tests) gets a folder of our own; any other must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        have = sc._jsc.sc().getCheckpointDir()
        named = have.get() if have.isDefined() else None
    if not named:
        if not sc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = LOCAL_DIR
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{checkpoint_root(spark)}/veriscope/{tag}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is written to fresh paths of the shared folder within; results must be written elsewhere by then."""
    token = _MADE.set(made := [])
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            delete(spark, path)


def materialise(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: a lost executor costs a re-read, not a recomputation.
    """
    return Scratch(df.sparkSession).keep(df, tag, codec)


class Scratch:
    """Steps of one operator in the shared folder; a step goes when what was made from it is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.steps: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = shared_path(self.spark, tag)
        df.write.option("compression", codec).parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.steps.append((read, path))
        return read

    def drop(self, *steps: DataFrame) -> None:
        """Delete the named steps; nothing that is still to run may read them."""
        for path in [p for df, p in self.steps if any(df is x for x in steps)]:
            delete(self.spark, path)
        self.steps = [x for x in self.steps if not any(x[0] is s for s in steps)]

    def drop_all_but(self, *steps: DataFrame) -> None:
        self.drop(*[df for df, _ in self.steps if not any(df is x for x in steps)])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def column(name: str) -> Column:
    """The column of a name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(docs: DataFrame, *without: str) -> tuple[list[str], list[Column]]:
    """(names, columns) of ``docs`` but for ``without``, under names by place.

    An operator's own columns never have the form ``c`` and a number, so no
    column of the input can clash with them.
    """
    names = [c for c in docs.columns if c not in without]
    return names, [column(c).alias(f"c{i}") for i, c in enumerate(names)]


def restored(names: list[str]) -> list[Column]:
    """The columns of :func:`carried` under their own names."""
    return [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


def open_fs(path: str):
    """(file system, path in it) of a path in the shared folder, local or remote."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 2 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``limit`` bytes of text.

    A slice holds whole rows, so one text above the limit is a slice alone.
    Slices are copies, so that a batch goes before the next one comes.
    """
    source = iter(batches)
    while (batch := next(source, None)) is not None:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        cuts, used = [0], 0
        for i, size in enumerate(sizes):
            if used and used + size > limit:
                cuts.append(i)
                used = 0
            used += size
        spans = list(zip(cuts, [*cuts[1:], batch.num_rows], strict=True)) if batch.num_rows else []
        for k, (start, end) in enumerate(spans):
            part = batch.take(pa.array(range(start, end), pa.int64()))
            if k == len(spans) - 1:
                batch = None
                pa.default_memory_pool().release_unused()
            yield part
            del part


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key of a stream sorted by ``keys``, one batch a key.

    Meant for keys with a bounded number of rows: those of one key are held.
    """
    import numpy as np

    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        held = batch.slice(cuts[-1])
    if held is not None:
        yield held


def unused(name: str, names: Iterable[str]) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``names``."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, *fields: StructField) -> StructType:
    """The schema of ``df`` with more fields at its end, all nullable."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + list(fields))


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest reachable.

    Alternates large and small stars.  A star's centre may hold any share of
    the rows: its smallest neighbour is a partial aggregate, and the join that
    follows is one that adaptive execution can split.  Each round is written
    to the shared folder and the one before goes; only a count and a checksum
    reach the driver.
    """
    scratch = scratch or Scratch(edges.sparkSession)

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.keep(e, "edges")
    now, before = state(e), None
    while now != before:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, scratch.keep(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(last)
        before, now = now, state(e)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
