"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadspark.operators.staging import materialize

# What separates words: space and the five ASCII line and page controls.
GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, which bounds what a task holds in Python besides the Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def running_totals(df: DataFrame, keys: list[str], sort: list[Column], size: str, before: str) -> DataFrame:
    """Add ``before``: the sum of ``size`` over the rows that precede a row in the order of ``sort`` within ``keys``.

    Rows are range-partitioned by key and order, so one hot key spreads over many tasks, and written once, which
    fixes the partitions before their sums are added up. One small window runs over the sums per partition, another
    inside each partition. Keep the rows narrow: they are shuffled twice.
    """
    full = [*[F.col(k) for k in keys], *sort]
    placed = materialize(df.repartitionByRange(*full).withColumn("_part", F.spark_partition_id()))
    groups = [*keys, "_part"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*groups).agg(F.sum(size).alias("_sum")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups).orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = placed.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return inner.join(offsets, same).select(*df.columns, (F.col("_before") + F.col("_inside")).alias(before))
