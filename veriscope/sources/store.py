"""Tables with natural keys, replaced by upsert: Parquet snapshots and what changed since.

Parquet has no MERGE.  An upsert writes its rows alone beside the last snapshot
(``d=N``); a reader takes the newest row of each key.  After ``DELTAS`` of them
the next upsert writes a snapshot (``v=N``), so that the cost of an upsert
follows its own size.  A folder counts once its _SUCCESS marker is there, so a
job that dies half way changes nothing, and readers keep using what they read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import INDEXES, KEYS

#: Upserts since the last snapshot after which the next one writes a snapshot.
DELTAS = 16


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of greatest ``version`` for each key; null keys equal one another."""
    order = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last())
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1).drop("__r")


def merge(old: DataFrame, new: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new``; of equal keys the new one counts.

    With ``only``, a row that is there changes these columns alone.  ``new``
    holds one row a key.
    """
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    out = latest(both, keys, "__v")
    if only:
        kept = [c for c in old.columns if c not in keys and c not in only]
        before = old.select(*keys, F.struct(*kept).alias("__old")) if kept else None
        if before is not None:
            same = [out[k].eqNullSafe(before[k]) for k in keys]
            out = out.join(before.drop_duplicates(keys), same, "left").select(
                *[out[k] for k in keys], *[out[c] for c in only], *[F.when(F.col("__old").isNotNull(), F.col(f"__old.{c}")).otherwise(out[c]).alias(c) for c in kept]
            )
    return out.select(*old.columns)


class Store:
    """Tables under ``root``; see ``KEYS`` for their keys."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folders(self, table: str) -> list[tuple[int, str]]:
        """(number, ``v`` or ``d``) of the folders that are complete, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [p.getName() for p in (s.getPath() for s in fs.listStatus(path)) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted((int(n[2:]), n[0]) for n in names if n[:2] in ("v=", "d="))

    def _live(self, table: str) -> list[tuple[int, str]]:
        """The last snapshot and what changed since."""
        have = self._folders(table)
        last = max((i for i, (_, kind) in enumerate(have) if kind == "v"), default=0)
        return have[last:]

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        live = self._live(table)
        if not live:
            return self.spark.createDataFrame([], schema) if schema else None
        frames = [self.spark.read.parquet(f"{self.root}/{table}/{kind}={n}").withColumn("__v", F.lit(n)) for n, kind in live]
        if len(frames) == 1:
            return frames[0].drop("__v")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return latest(rows, KEYS[table], "__v").drop("__v")

    def upsert(self, table: str, rows: DataFrame, keys: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
        """Replace the rows of equal keys, or add them.  Tables whose keys ``KEYS`` has not are rewritten whole."""
        live, known = self._live(table), KEYS.get(table)
        keys = keys or known
        rows = latest(rows.withColumn("__one", F.lit(0)), keys, "__one").drop("__one")
        kind, n = "v", (live or [(0, "")])[-1][0] + 1
        if live:
            old = self.read(table)
            if keys == known and len(live) <= DELTAS:
                kind = "d"
                if only:
                    rows = merge(old.join(rows.select(*keys), keys, "left_semi"), rows, keys, only)
            else:
                rows = merge(old, rows, keys, only)
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/{kind}={n}")
        return self.read(table)

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to a table that only grows."""
        rows.write.mode("append").parquet(f"{self.root}/{table}")

    def read_all(self, table: str, schema: str) -> DataFrame:
        """A table that only grows, as it is now; empty before the first row."""
        path = f"{self.root}/{table}"
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jpath):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a step of a plan and read it back."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def vacuum(self, table: str, keep: int = 2) -> None:
        """Delete all but the last ``keep`` folders that are older than what is read."""
        old = [f for f in self._folders(table) if f not in self._live(table)]
        for n, kind in old[: len(old) - keep + 1] if keep > 1 else old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{kind}={n}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def ensure_index(self, index_id: str, make, force: bool = False, dataset: str = "", index_hash: str = "") -> tuple[DataFrame, bool]:
        """(chunks of an index, whether they were there): made once; an index with chunks is used again.

        The manifest ``indexes`` has its number of chunks and their dimension.
        """
        path = f"{self.root}/chunks/index_id={index_id}"
        known = self.read("indexes", INDEXES).where((F.col("index_id") == index_id) & (F.col("n_chunks") > 0))
        reused = not force and not known.isEmpty()
        if not reused:
            make().write.mode("overwrite").parquet(path)
            chunks = self.spark.read.parquet(path)
            self.upsert("indexes", index_sizes(chunks.withColumn("index_id", F.lit(index_id))).select(
                "index_id", F.lit(dataset).alias("dataset"), F.lit(index_hash).alias("index_hash"), "n_chunks", "dim"
            ))
        return self.spark.read.parquet(path), reused


def index_sizes(chunks: DataFrame) -> DataFrame:
    """(index_id, n_chunks, dim) of chunks; ``dim`` is null without vectors."""
    dim = F.max(F.size("vector")) if "vector" in chunks.columns else F.lit(None)
    return chunks.groupBy("index_id").agg(F.count("*").alias("n_chunks"), dim.cast("int").alias("dim"))
