"""Running totals and row numbers that stay distributed even when one file is the whole input.

A window over one file would put that file into one task. Here rows are range-partitioned by key and order and written
once, which fixes the partitions. One window runs over the partitions' totals (a row per key and partition), another inside
each partition, and the two are added. Null keys are keys like any other, and null positions come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.operators.staging import materialize


def _placed(df: DataFrame, keys: list[str], order: list[Column | str], parts: int | None = None) -> DataFrame:
    """Rows in range partitions by key and order, numbered in ``_part``, written once."""
    by = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order]]
    ranged = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()))


def _with_offsets(rows: DataFrame, offsets: DataFrame, groups: list[str]) -> DataFrame:
    """Join per-partition ``offsets`` to their rows; null keys match."""
    renamed = offsets.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return rows.join(renamed, same)


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]],
            parts: int | None = None) -> DataFrame:
    """Add inclusive running sums / maxima per ``keys`` in the order of the unique column ``order``.

    ``values`` maps a new column name to ("sum" | "max", value). ``parts`` fixes the number of range partitions.
    """
    fold = {"sum": F.sum, "max": F.max}
    placed = _placed(df.withColumns({f"_v_{n}": v for n, (_, v) in values.items()}), keys, [order], parts)
    groups = [*keys, "_part"]
    totals = placed.groupBy(*groups).agg(*[fold[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, *[fold[k](f"_t_{n}").over(earlier).alias(f"_o_{n}")
                                       for n, (k, _) in values.items()])
    inside = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumns({f"_h_{n}": fold[k](f"_v_{n}").over(inside) for n, (k, _) in values.items()})

    def total(n: str, k: str) -> Column:
        now, before = F.col(f"_h_{n}"), F.col(f"_o_{n}")
        return F.coalesce(before, F.lit(0)) + now if k == "sum" else F.greatest(before, now)

    return _with_offsets(here, offsets, groups).select(*df.columns, *[total(n, k).alias(n) for n, (k, _) in values.items()])


def number_rows(df: DataFrame, keys: list[str], order: str, name: str, parts: int | None = None) -> DataFrame:
    """Add 1-based row numbers per ``keys`` in the order of the unique column ``order``."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, parts)


def number_sorted(df: DataFrame, keys: list[str], sort: list[Column], order: str, name: str) -> DataFrame:
    """Add 1-based row numbers per ``keys`` in the order of ``sort`` and then ``order``.

    Rows are range-partitioned by the full sort key, so one large group spreads over many tasks; the
    partitions are written out once, which fixes them before their sizes are added up.
    """
    placed = _placed(df, keys, [*sort, order])
    groups = [*keys, "_part"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*groups).agg(F.count("*").alias("_n")).select(
        *groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups).orderBy(*sort, order)
    here = placed.withColumn("_here", F.row_number().over(inside))
    return _with_offsets(here, offsets, groups).select(
        *df.columns, (F.col("_before") + F.col("_here")).cast("bigint").alias(name))
