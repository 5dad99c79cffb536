"""Concept de-duplication: wrapper functions by name, near copies by meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.operators.clustering import leader_clusters
from conceptmine.operators.skew import salted_join
from conceptmine.session import materialize


def _wrapper_pairs(concepts: DataFrame, prefix: str) -> DataFrame:
    """(module, snake-cased class name) of every class, with the class's full name."""
    name = F.col("name")
    module = tx.module_of_concept(name, prefix)
    return concepts.where(F.col("type") == "Class").select(
        module.alias("module"), tx.snake_case(tx.last_part(name, ".")).alias("def_name"),
        name.alias("class_name"))


def _function_keys(concepts: DataFrame, prefix: str) -> DataFrame:
    name = F.col("name")
    return concepts.where(F.col("type") == "Function").select(
        "*", tx.module_of_concept(name, prefix).alias("module"), tx.last_part(name, ".").alias("def_name"))


def drop_wrappers(concepts: DataFrame, prefix: str) -> DataFrame:
    """Drop functions named like the snake-cased class of their module."""
    functions = _function_keys(concepts, prefix)
    kept = functions.join(_wrapper_pairs(concepts, prefix), ["module", "def_name"], "left_anti")
    others = concepts.where(~F.col("type").eqNullSafe("Function"))
    return others.unionByName(kept.drop("module", "def_name"))


def wrapper_audit(concepts: DataFrame, prefix: str) -> DataFrame:
    functions = _function_keys(concepts, prefix)
    pairs = functions.join(_wrapper_pairs(concepts, prefix), ["module", "def_name"])
    return pairs.select(
        F.col("name").alias("removed"),
        F.concat(F.lit("Wrapper for class "), F.col("class_name")).alias("reason"), "summary")


def is_deprecated() -> Column:
    in_source = F.contains(F.coalesce("source_code", F.lit("")), F.lit("@deprecate"))
    in_doc = F.contains(F.lower(F.coalesce("docstring", F.lit(""))), F.lit("deprecated"))
    return in_source | in_doc


def preference(order: list[Column]) -> Column:
    """Sort key of the best concept of a cluster; the largest wins, ties go to the earliest."""
    return F.struct(
        (~is_deprecated()).alias("current"),
        F.coalesce("is_target_subclass", F.lit(False)).alias("target"),
        (F.col("type") == "Class").alias("class"),
        F.coalesce(F.array_contains("base_classes", "Gate"), F.lit(False)).alias("gate"),
        F.length("docstring").alias("length"),
        *[(-c).alias(f"place{i}") for i, c in enumerate(order)],
    )


def best_of_cluster(clustered: DataFrame, ord_col: str = "ord") -> DataFrame:
    """One concept per ``cluster``; ``max_by`` combines on the map side, no group is gathered."""
    columns = [c for c in clustered.columns if c != "cluster"]
    best = clustered.groupBy("cluster").agg(
        F.max_by(F.struct(*columns), preference([F.col(ord_col)])).alias("best"))
    return best.select("cluster", "best.*")


def cluster_audit(clustered: DataFrame, best: DataFrame) -> DataFrame:
    """Which concept was removed in favour of which."""
    kept = best.select("cluster", F.col("name").alias("kept"), F.col("summary").alias("kept_summary"))
    return salted_join(clustered, kept, "cluster").where(F.col("name") != F.col("kept")).select(
        F.col("name").alias("removed"), "kept", F.lit("cluster").alias("similarity"),
        F.col("summary").alias("removed_summary"), "kept_summary")


def semantic_dedup(concepts: DataFrame, threshold: float = 0.95, **options) -> tuple[DataFrame, DataFrame]:
    """``concepts(ord, vec, ...)`` to (kept concepts, audit of removed ones)."""
    clusters = leader_clusters(concepts.select("ord", "vec"), threshold, **options)
    clustered = materialize(concepts.join(clusters.select("ord", F.col("leader").alias("cluster")), "ord"))
    best = best_of_cluster(clustered)
    return best.drop("cluster", "vec"), cluster_audit(clustered, best)
