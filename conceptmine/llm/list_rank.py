"""Sums from every element of a linked list to the list's end, by pointer doubling.

First every stretch of the list that lies together in a block becomes one piece (windows
over the blocks). Then pieces double their pointers: in each round a piece adds the sum that
the piece it points to has, and points to where that one points, so the rounds grow with the
logarithm of the number of pieces, whatever the list looks like. Any blocks give right sums;
good ones leave few pieces. A block must be of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptmine.session import materialize


def _doubled(pieces: DataFrame, sums: list[str]) -> DataFrame:
    """Every piece with the sums of the piece it points to, pointing to where that one points."""
    ahead = pieces.select(F.col("piece").alias("next"), F.col("next").alias("_next"),
                          *[F.col(s).alias(f"_{s}") for s in sums])
    own = [c for c in pieces.columns if c not in ("next", *sums)]
    return pieces.join(ahead, "next", "left").select(
        *own, F.col("_next").alias("next"), *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums])


def suffix_sums(items: DataFrame, block: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """``id`` and the sums of ``sums`` over the element and all after it, for items(id, next, ...).

    ``id`` is unique, ``next`` null at an end of a list. ``block`` and ``order`` say which
    elements lie together, and how; a list has no loop.
    """
    lie = Window.partitionBy(*block).orderBy(*order)
    upto, piece_order = lie.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*block, "piece").orderBy("_at")
    after = piece_order.rowsBetween(0, Window.unboundedFollowing)
    whole = piece_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a piece begins where the element before in the block isn't the one before in the list
    begins = ~F.lag("next").over(lie).eqNullSafe(F.col("id"))
    placed = items.withColumn("_at", F.row_number().over(lie)).withColumn("_begins", F.when(begins, F.col("id")))
    placed = placed.withColumn("piece", F.last("_begins", ignorenulls=True).over(upto))
    placed = materialize(placed.select(
        "id", "piece", F.last("next").over(whole).alias("next"), *[F.sum(s).over(after).alias(s) for s in sums]))

    pieces = placed.where(F.col("id") == F.col("piece")).select(
        "piece", *[F.col(s).alias(f"own_{s}") for s in sums], "next", *sums)
    while True:
        # two rounds for each written table
        pieces = materialize(_doubled(_doubled(pieces, sums), sums))
        if pieces.where("next IS NOT NULL").isEmpty():
            break
    rest = pieces.select("piece", *[(F.col(s) - F.col(f"own_{s}")).alias(f"rest_{s}") for s in sums])
    return placed.drop("next").join(rest, "piece").select(
        "id", *[(F.col(s) + F.col(f"rest_{s}")).alias(s) for s in sums])
