"""Inter-rater agreement from a table with one column per rater.

The ratings of a subject sit in one row, so per-subject agreement is a row
expression; only category counts are shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.functions import text as tx


def clean_ratings(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """Drop rows with a missing rating, then trim (blank texts stay as '')."""
    kept = ratings.dropna(subset=raters)
    return kept.withColumns({r: tx.strip(F.col(r).cast("string")) for r in raters})


def count_matrix(ratings: DataFrame, item: str, raters: list[str]) -> DataFrame:
    """``(item, category, n)``: how many raters put a subject into a category.

    Counted inside the row, so no subject is regrouped.
    """
    votes = F.array(*[F.col(r) for r in raters])
    cats = F.explode(F.array_distinct(votes)).alias("category")
    return clean_ratings(ratings, raters).select(F.col(item).alias("item"), votes.alias("v"), cats).select(
        "item", "category", F.size(F.filter("v", lambda x: x == F.col("category"))).cast("bigint").alias("n"))


def _votes(ratings: DataFrame, raters: list[str]) -> DataFrame:
    return ratings.select(F.explode(F.array(*[F.col(r) for r in raters])).alias("category"))


def fleiss_kappa(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """One row ``kappa``; NaN when only one category was ever used."""
    cleaned, n = clean_ratings(ratings, raters), len(raters)
    agreeing = sum((F.col(a) == F.col(b)).cast("int") for a, b in combinations(raters, 2))
    observed = cleaned.agg(F.avg(2 * agreeing / F.lit(n * (n - 1))).alias("v")).scalar()
    counted = _votes(cleaned, raters).groupBy("category").agg(F.count("*").alias("n"))
    chance = counted.agg(
        (F.sum(F.col("n").cast("double") * F.col("n")) / (F.sum("n").cast("double") * F.sum("n"))).alias("pe"))
    kappa = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(F.lit(float("nan")))
    return chance.withColumn("po", observed).select(kappa.alias("kappa"))


def cohen_kappas(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """``(pair, kappa)`` for every pair of raters, in the order of ``raters``.

    One pass counts the confusion matrices of all pairs together; everything
    after it works on those counts.
    """
    pairs = [
        F.struct(F.lit(f"{a} vs {b}").alias("pair"), F.col(a).alias("a"), F.col(b).alias("b"))
        for a, b in combinations(raters, 2)
    ]
    confusion = (
        clean_ratings(ratings, raters).select(F.inline(F.array(*pairs)))
        .groupBy("pair", "a", "b").agg(F.count("*").alias("n"))
    )
    total = confusion.groupBy("pair").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    # both marginals of a category meet in one group
    marginals = confusion.select(
        "pair", F.inline(F.array(
            F.struct(F.col("a").alias("category"), F.col("n").alias("left"), F.lit(0).cast("bigint").alias("right")),
            F.struct(F.col("b").alias("category"), F.lit(0).cast("bigint").alias("left"), F.col("n").alias("right")),
        ))).groupBy("pair", "category").agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    chance = marginals.groupBy("pair").agg(F.sum(F.col("left").cast("double") * F.col("right")).alias("product"))
    po, pe = F.col("same") / F.col("total"), F.col("product") / (F.col("total").cast("double") * F.col("total"))
    return total.join(chance, "pair").select("pair", po.alias("po"), pe.alias("pe")).select(
        "pair", F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe")))
        .otherwise(F.lit(float("nan"))).alias("kappa"))


def lights_kappa(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """Mean of the pairwise kappas and its wording."""
    mean = cohen_kappas(ratings, raters).agg(F.avg("kappa").alias("kappa"))
    return mean.select("kappa", tx.kappa_label(F.col("kappa")).alias("interpretation"))
