"""Deterministic samples that keep every stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratified_sample(rows: DataFrame, n: int, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """About ``n`` rows, each stratum in proportion and with one at least, in the order of md5(seed:key).

    A sample above ``n`` is trimmed in that order; one below stays as it is.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("__size"))
    total = sizes.agg(F.sum("__size").alias("__total"))
    quota = sizes.crossJoin(F.broadcast(total)).select(stratum, F.greatest(F.lit(1), F.bround(F.lit(float(n)) * F.col("__size") / F.col("__total"))).alias("__quota"))
    order = Window.partitionBy(stratum).orderBy("__h", key)
    picked = hashed.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).join(F.broadcast(quota), stratum).where(F.col("__r") <= F.col("__quota"))
    return picked.orderBy("__h", key).limit(n).select(*rows.columns)


def split(rows: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``split``: eval for those of the sample, else pool."""
    return rows.join(sample.select(key, F.lit("eval").alias("split")).distinct(), key, "left").withColumn("split", F.coalesce("split", F.lit("pool")))
