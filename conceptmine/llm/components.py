"""Connected components of an edge table by alternating large and small stars.

Every round ties the neighbours of each node to the smallest one. With ``hubs`` a node with more
edges than a shuffle partition has on average (there are fewer of these than partitions) has its
edges dealt to slices, so a hub that holds a whole component is work for many tasks; it takes
two more written tables a round. Rounds grow with the logarithm of the longest path, not with its length.

Defined results: loops and repeated edges change nothing; an edge with a null end is
none; an empty table has no nodes; further columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.session import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _with_least(rows: DataFrame, hubs: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (u, v) with ``m``, the smallest v of u, and ``least(u, m)`` itself; with ``hubs`` rows of a hub are in slices."""
    if not hubs:
        least = rows.groupBy("u").agg(F.min("v").alias("m"))
        return rows.join(least, "u"), least
    least = materialize(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    total = least.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slices = F.ceil(F.col("n") / share).cast("int")
    # fewer rows than shuffle partitions
    large = F.broadcast(least.where(F.col("n") > share).select("u", slices.alias("slices")))
    spread = rows.join(large, "u", "left").withColumn("slice", F.pmod(F.xxhash64("v"), F.coalesce("slices", F.lit(1))).cast("int"))
    copies = least.withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(slices, F.lit(1)) - 1))).drop("n")
    return spread.drop("slices").join(copies, ["u", "slice"]).drop("slice"), least.drop("n")


def _large(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every larger neighbour is tied to the smallest node of the neighbourhood."""
    both, _ = _with_least(edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v"), hubs)
    return both.where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small(edges: DataFrame, hubs: bool) -> DataFrame:
    """Every smaller neighbour, and the node itself, is tied to the smallest one."""
    down, least = _with_least(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), hubs)
    return down.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))


def components(edges: DataFrame, hubs: bool = False) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for all nodes of edges (a, b)."""
    def settled(x: DataFrame) -> DataFrame:
        return materialize(x.where("a <> b").distinct())

    stars = settled(edges.select("a", "b"))  # a null end is not unlike the other
    before = _state(stars)
    while before[0]:
        larger = _large(stars, hubs)
        stars = settled(_small(materialize(larger) if hubs else larger, hubs))
        now = _state(stars)
        if now == before:
            break
        before = now
    # all edges are (node, smallest) now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        stars.select(F.col("b"), F.col("b")).distinct())
