"""One row per key, top-k and row numbers without single-task windows.

A window over a key sorts all rows of that key in one task. ``min_by`` and
``max_by`` combine on the map side instead, so a key holding a third of all
rows shrinks to one candidate per input partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptmine.session import materialize


def _pick(df: DataFrame, keys: list[str], order: list[Column], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = chooser(F.struct(*rest), F.struct(*order)).alias("_best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Consecutive row numbers in ``order`` (unique, end it with a key) for a table of any size.

    The sorted table is written once (its partitions are ranges of the order);
    each partition's offset is the row count before it, so the only table that
    is joined small has one row per partition.
    """
    ranged = df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"),
        # the low 33 bits number the rows inside a partition
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    ranged = materialize(ranged)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_part").select(
        (F.col("_before") + F.col("_row") + start).alias(name), *df.columns)
