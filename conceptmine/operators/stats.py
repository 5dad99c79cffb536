"""Report tables over the match fact table.

Group keys that are null never form a group, ties are broken by the keys, and
lists of names are built from rows that are already distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.session import materialize


#: What the report's tables are grouped by.
GRAIN = ["match_type", "framework", "project", "concept_name", "pattern"]


def weighted(matches: DataFrame) -> DataFrame:
    """Match rows with ``_n`` (matches), ``_scored`` (those with a score) and ``_total`` (sum of scores); a base has them already.

    Scores are summed in decimals: the same value however the rows are partitioned.
    """
    if "_n" in matches.columns:
        return matches
    score = F.col("similarity_score").try_cast("decimal(18,9)")
    return matches.withColumns({"_n": F.lit(1).cast("long"), "_scored": score.isNotNull().cast("long"), "_total": score})


def base(matches: DataFrame, grain: list[str] | None = None) -> DataFrame:
    """The matches counted by ``grain``, written once. Every table below can be made from it instead of the matches."""
    return materialize(weighted(matches).groupBy(*grain or GRAIN).agg(
        F.sum("_n").alias("_n"), F.sum("_scored").alias("_scored"), F.sum("_total").cast("decimal(28,9)").alias("_total")))


def mean_score() -> Column:
    total = F.sum("_total").cast("decimal(28,9)")
    return total / F.nullif(F.sum("_scored"), F.lit(0)).cast("decimal(18,0)")


def with_pattern(matches: DataFrame) -> DataFrame:
    return matches.where(tx.to_null(F.col("pattern")).isNotNull())


def counts_by(df: DataFrame, key: str, name: str = "matches") -> DataFrame:
    return weighted(df).where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("_n").alias(name)).orderBy(F.desc(name), key)


def mean_score_by(df: DataFrame, key: str, name: str = "avg_score") -> DataFrame:
    means = weighted(df).where(F.col(key).isNotNull()).groupBy(key).agg(
        F.bround(mean_score(), 4).cast("double").alias(name))
    return means.orderBy(F.desc(name), key)


def overview(matches: DataFrame) -> DataFrame:
    """One row: matches, files, concepts and mean score (0.0 when there is none).

    Matches are read once; files and concepts are counted on what is left of them.
    """
    pairs = base(matches, ["file_path", "concept_name"])
    counted = {name: pairs.select(c).distinct().agg(F.count(c)).scalar() for name, c in (("files", "file_path"), ("concepts", "concept_name"))}
    return pairs.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_matches"),
        F.coalesce(mean_score().cast("double"), F.lit(0.0)).alias("avg_score"),
    ).withColumns(counted).select("total_matches", "files", "concepts", "avg_score")


def unmatched_patterns(matches: DataFrame, defined: DataFrame) -> DataFrame:
    """Defined patterns no match carries, sorted."""
    found = with_pattern(matches).select("pattern").distinct()
    return defined.select("pattern").distinct().join(found, "pattern", "left_anti").orderBy("pattern")


def basic_statistics(matches: DataFrame, defined: DataFrame) -> DataFrame:
    """One row: matches, patterns found, mean score, patterns not found. Matches are read once."""
    patterns = base(matches, ["pattern"])
    measured = patterns.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_matches"),
        F.count_distinct(tx.to_null(F.col("pattern"))).alias("found_patterns"),
        F.coalesce(mean_score().cast("double"), F.lit(0.0)).alias("avg_score"),
    )
    missing = unmatched_patterns(patterns, defined).agg(F.count("*").alias("n"))
    return measured.withColumn("unmatched_patterns", missing.scalar())


def patterns_in_frameworks(matches: DataFrame) -> DataFrame:
    keyed = weighted(with_pattern(matches)).where(F.col("framework").isNotNull())
    return keyed.groupBy("framework", "pattern").agg(F.sum("_n").alias("matches")).orderBy(
        "framework", F.desc("matches"), "pattern")


def source_table(matches: DataFrame) -> DataFrame:
    """Per pattern its matches and the sorted frameworks they come from."""
    pairs = weighted(with_pattern(matches)).groupBy("pattern", "framework").agg(F.sum("_n").alias("n"))
    return pairs.groupBy("pattern").agg(
        F.sum("n").alias("total_matches"),
        F.array_join(F.array_sort(F.collect_list("framework")), ", ").alias("source_framework_names"),
    ).orderBy(F.desc("total_matches"), "pattern")


def adoption_projects(matches: DataFrame) -> DataFrame:
    """One row per pattern and project, with the number of matches that have a score."""
    return weighted(with_pattern(matches)).groupBy("pattern", "project").agg(F.sum("_scored").alias("matches"))


def adoption_table(matches: DataFrame, most: int | None = None) -> DataFrame:
    """Per pattern the number of projects that use it and of matches that have a score, and the projects' names in order.

    ``most`` bounds the names in a row, others are counted as ``(+n more)``; all of them, as published,
    without it. ``adoption_projects`` has all in rows of their own.
    """
    pairs = adoption_projects(matches)
    sums = [F.sum("matches").alias("total_matches"), F.count("project").alias("target_project_coverage")]
    names = F.array_join(F.array_sort(F.collect_list("project")), ", ").alias("target_project_names")
    if most is None:
        table = pairs.groupBy("pattern").agg(*sums, names)
    else:
        pairs = materialize(pairs)
        # ranks are cut before the shuffle: a pattern leaves a task with at most `most` names
        place = F.row_number().over(Window.partitionBy("pattern").orderBy("project"))
        first = pairs.where(F.col("project").isNotNull()).withColumn("_place", place).where(F.col("_place") <= most)
        more = F.col("target_project_coverage") - most
        table = pairs.groupBy("pattern").agg(*sums).join(first.groupBy("pattern").agg(names), "pattern", "left").withColumn(
            "target_project_names", F.concat(F.coalesce("target_project_names", F.lit("")),
                                             F.when(more > 0, F.format_string(" (+%d more)", more)).otherwise("")))
    return table.orderBy(F.desc("target_project_coverage"), "pattern")


def top_concepts(matches: DataFrame, n: int = 20) -> DataFrame:
    """The n most matched concepts, one row per framework they appear under."""
    pairs = weighted(matches).where(F.col("concept_name").isNotNull()).groupBy("concept_name", "framework").agg(
        F.sum("_n").alias("n"))
    # a concept carries few frameworks; listing them spares a second pass over the matches
    counted = pairs.groupBy("concept_name").agg(
        F.sum("n").alias("matches"), F.collect_list("framework").alias("frameworks"))
    top = counted.orderBy(F.desc("matches"), "concept_name").limit(n)
    origins = top.select("concept_name", "matches", F.explode("frameworks").alias("framework"))
    return origins.select(
        "concept_name", tx.capitalize(F.col("framework")).alias("Framework"),
        tx.display_name(F.col("concept_name")).alias("Concept"), F.col("matches").alias("Matches"),
    ).orderBy(F.desc("Matches"), "concept_name", "Framework")


def concept_counts(matches: DataFrame) -> DataFrame:
    keyed = weighted(matches).where(F.col("framework").isNotNull() & F.col("concept_name").isNotNull())
    return keyed.groupBy("framework", "concept_name").agg(F.sum("_n").alias("matches"))


def top_framework_concepts(matches: DataFrame, n: int = 20) -> DataFrame:
    return concept_counts(matches).select(
        F.col("framework").alias("Framework"), F.col("concept_name").alias("Concept"),
        F.col("matches").alias("Matches"),
    ).orderBy(F.desc("Matches"), "Framework", "Concept").limit(n)


def watch_list(matches: DataFrame, watched: DataFrame) -> DataFrame:
    """Every watched pattern with its number of matches, 0 when never found."""
    names = watched.select("pattern").distinct()
    counted = weighted(with_pattern(matches)).join(names, "pattern", "left_semi").groupBy("pattern").agg(
        F.sum("_n").alias("n"))
    return names.join(counted, "pattern", "left").select(
        "pattern", F.coalesce("n", F.lit(0)).alias("matches")).orderBy(F.desc("matches"), "pattern")


def watch_summary(matches: DataFrame, watched: DataFrame) -> DataFrame:
    return watch_list(matches, watched).agg(
        F.count_if(F.col("matches") > 0).alias("found"), F.count("*").alias("watched"))


def found_watched(matches: DataFrame, watched: DataFrame) -> DataFrame:
    return with_pattern(matches).select("pattern").intersect(watched.select("pattern"))
