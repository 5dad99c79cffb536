"""Pattern coverage: which base patterns the frameworks' concepts realise.

``uses(framework, name, pattern)`` is the labelled concept table, ``base(pattern)``
the catalogue to cover.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptmine.functions import text as tx


def framework_patterns(uses: DataFrame) -> DataFrame:
    """Distinct ``(framework, pattern)``."""
    pattern = tx.strip(F.col("pattern")).alias("pattern")
    return uses.select("framework", pattern).where(F.col("pattern") != "").distinct()


def all_patterns(uses: DataFrame) -> DataFrame:
    return framework_patterns(uses).select("pattern").distinct()


def pattern_counts(uses: DataFrame) -> DataFrame:
    return framework_patterns(uses).groupBy("framework").agg(F.count("*").alias("patterns"))


def missing_and_extra(uses: DataFrame, base: DataFrame) -> DataFrame:
    """``(pattern, status)``: base patterns nobody has, patterns outside the base."""
    found, wanted = all_patterns(uses), base.select("pattern").distinct()
    both = wanted.withColumn("in_base", F.lit(True)).join(
        found.withColumn("found", F.lit(True)), "pattern", "full_outer")
    return both.where(F.col("in_base").isNull() | F.col("found").isNull()).select(
        "pattern", F.when(F.col("found").isNull(), "missing").otherwise("extra").alias("status"))


def coverage(uses: DataFrame, base: DataFrame) -> DataFrame:
    """One row: covered base patterns, base patterns and the percentage (0 for an empty base)."""
    found = all_patterns(uses).withColumn("hit", F.lit(1))
    both = base.select("pattern").distinct().join(found, "pattern", "left")
    counted = both.agg(F.count("hit").alias("covered"), F.count("*").alias("base"))
    share = F.when(F.col("base") > 0, F.col("covered") / F.col("base") * 100).otherwise(F.lit(0.0))
    return counted.withColumn("coverage_pct", share)


def framework_coverage(uses: DataFrame, base: DataFrame) -> DataFrame:
    """Per framework the base patterns it has and their share."""
    wanted = base.select("pattern").distinct()
    hits = framework_patterns(uses).join(wanted, "pattern", "left_semi").groupBy("framework").agg(
        F.count("*").alias("covered"))
    total = wanted.agg(F.count("*").alias("n"))
    return uses.select("framework").distinct().join(hits, "framework", "left").select(
        "framework", F.coalesce("covered", F.lit(0)).alias("covered")
    ).withColumn("base", total.scalar()).withColumn(
        "coverage_pct", F.when(F.col("base") > 0, F.col("covered") / F.col("base") * 100).otherwise(F.lit(0.0)))


def _concepts(uses: DataFrame) -> DataFrame:
    cleaned = uses.select("framework", tx.strip(F.col("name")).alias("name"), tx.strip(F.col("pattern")).alias("pattern"))
    return cleaned.where((F.col("name") != "") & (F.col("pattern") != "")).distinct()


def pattern_sources(uses: DataFrame, shown: int = 3) -> DataFrame:
    """Per framework and pattern: number of concepts and the first few by name.

    The first names come from a rank limit, so a pattern with very many
    concepts is never gathered.
    """
    concepts = _concepts(uses)
    counted = concepts.groupBy("framework", "pattern").agg(F.count("*").alias("concepts"))
    place = F.row_number().over(Window.partitionBy("framework", "pattern").orderBy("name"))
    first = concepts.withColumn("_place", place).where(F.col("_place") <= shown)
    examples = first.groupBy("framework", "pattern").agg(
        F.array_sort(F.collect_list(F.struct("name"))).alias("_first"))
    label = F.array_join(F.transform("_first", lambda s: tx.last_part(s["name"], "/")), ", ")
    more = F.when(F.col("concepts") > shown,
                  F.concat(F.lit(" (+"), (F.col("concepts") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return counted.join(examples, ["framework", "pattern"]).select(
        "framework", "pattern", "concepts", F.concat(label, more).alias("examples"))


def extra_pattern_sources(uses: DataFrame, base: DataFrame) -> DataFrame:
    """Concepts behind each pattern outside the base: one row per concept, with the group's size."""
    extra = _concepts(uses).join(base.select("pattern").distinct(), "pattern", "left_anti")
    sizes = extra.groupBy("pattern", "framework").agg(F.count("*").alias("concepts"))
    return extra.join(sizes, ["pattern", "framework"]).select(
        "pattern", "framework", "concepts", tx.last_part(F.col("name"), "/").alias("concept"))


def coverage_matrix(uses: DataFrame, frameworks: list[str]) -> DataFrame:
    """One row per pattern, one 0/1 column per listed framework, and how many frameworks have it, listed or not."""
    flags = [F.max(F.when(F.col("framework") == f, 1).otherwise(0)).alias(f) for f in frameworks]
    return framework_patterns(uses).groupBy("pattern").agg(*flags, F.count("*").cast("int").alias("frameworks"))


def common_patterns(matrix: DataFrame, frameworks: list[str]) -> DataFrame:
    """Patterns every one of the given frameworks has (pairs, triples, ...)."""
    shared = F.lit(True)
    for f in frameworks:
        shared &= F.col(f"`{f}`") == 1
    return matrix.where(shared).select("pattern")


def pairwise_common(uses: DataFrame) -> DataFrame:
    """How many patterns each pair of frameworks shares.

    Patterns with the same set of frameworks are counted together first; pairs
    are formed per distinct set, not per pattern.
    """
    sets = framework_patterns(uses).groupBy("pattern").agg(F.array_sort(F.collect_list("framework")).alias("fs"))
    counted = sets.groupBy("fs").agg(F.count("*").alias("n"))
    first = counted.select("fs", "n", F.posexplode("fs").alias("i", "framework_a"))
    rest = F.slice(F.col("fs"), F.col("i") + 2, F.size("fs"))
    pairs = first.select("framework_a", F.explode(rest).alias("framework_b"), "n")
    return pairs.groupBy("framework_a", "framework_b").agg(F.sum("n").alias("common"))


def only_in(uses: DataFrame, other: DataFrame) -> DataFrame:
    """Patterns of ``uses`` that ``other(pattern)`` does not have."""
    return all_patterns(uses).join(other.select("pattern").distinct(), "pattern", "left_anti")
