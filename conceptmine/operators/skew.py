"""Equi-join that stays balanced when one key holds a large share of the left rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from so many left rows on, if that is more than its share of the shuffle partitions too.
HOT_ROWS = 100_000


def salted_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join on ``key``; left rows of hot keys are spread over slices.

    A key is hot when it has more rows than a shuffle partition gets on average
    (and at least ``hot_rows``), so there can be no more hot keys than partitions:
    that bounds their table, which is broadcast, and leaves no hot key out. A
    slice is one partition's share. Only right rows of hot keys are repeated, once
    per slice. ``left`` is read twice more to count its keys: pass a written table, or the
    rows of each key as ``counts(key, _n)`` where they are known already.
    """
    spark = left.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = left.count() if counts is None else counts.agg(F.sum("_n")).first()[0] or 0
    share = max(hot_rows, -(-total // partitions))
    if counts is None:
        counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.where(F.col("_n") > share).select(
        key, F.ceil(F.col("_n") / share).cast("int").alias("_slices"))
    # rows of one key must differ somewhere to spread: hash all their columns
    others = [c for c in left.columns if c != key] or [key]
    slices = F.coalesce("_slices", F.lit(1))
    spread = left.join(F.broadcast(hot), key, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(*others), slices).cast("int")).drop("_slices")
    repeated = right.join(F.broadcast(hot), key, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("_slices")
    return spread.join(repeated, [key, "_slice"], how).drop("_slice")
