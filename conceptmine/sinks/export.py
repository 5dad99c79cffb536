"""Writers. Each table is one Spark write; a folder of part files is the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.operators import coverage, lookup, repos, stats

CSV = {"quote": '"', "escape": '"', "header": "true", "emptyValue": ""}


def _csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").options(sep=sep, **CSV).csv(path)


def match_output(matches: DataFrame) -> DataFrame:
    """Match rows as published: fixed column order, 'N/A' patterns, four-digit scores."""
    return matches.select(
        "file_path", "concept_name", F.coalesce("pattern", F.lit(tx.MISSING)).alias("pattern"), "match_type",
        "matched_text", tx.score_text(F.col("similarity_score")).alias("similarity_score"))


def write_matches(matches: DataFrame, path: str, csv_path: str | None = None) -> None:
    """Parquet as the table later jobs read; the ``;`` text form on request."""
    matches.write.mode("overwrite").parquet(path)
    if csv_path:
        _csv(match_output(matches.sparkSession.read.parquet(path)), csv_path, sep=";")


def write_concepts_json(concepts: DataFrame, path: str) -> None:
    concepts.drop("source_code").write.mode("overwrite").json(path)


def write_concepts_csv(concepts: DataFrame, path: str, sep: str = ",") -> None:
    _csv(concepts.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("summary", F.lit("")).alias("summary")),
         path, sep)


def snippets(concepts: DataFrame, strip_all: bool = True) -> DataFrame:
    """``(framework, snippet_key, source_code)`` of concepts that have source text."""
    return concepts.where(F.col("source_code") != "").select(
        tx.framework_of(F.col("name")).alias("framework"),
        tx.snippet_key(F.col("name"), strip_all).alias("snippet_key"), "source_code")


def write_snippets(concepts: DataFrame, path: str, strip_all: bool = True) -> None:
    """One table partitioned by framework instead of one file per concept."""
    snippets(concepts, strip_all).write.mode("overwrite").partitionBy("framework").parquet(path)


def write_unclassified(resolved: DataFrame, path: str) -> None:
    """The to-do table; an empty one replaces what an earlier run left."""
    _csv(lookup.unclassified(resolved), path)


def write_pattern_list(patterns: DataFrame, path: str) -> None:
    names = patterns.select(F.col("pattern").alias("PatternName")).distinct().orderBy("PatternName")
    _csv(names, path)


def write_knowledge_base(kb: DataFrame, path: str) -> None:
    _csv(lookup.consolidate(kb), path)


def report_tables(matches: DataFrame, defined: DataFrame, watched: DataFrame) -> dict[str, DataFrame]:
    """The report's tables by name, with their published headers."""
    with_pattern = stats.with_pattern(matches)
    return {
        "match_type_counts": stats.counts_by(matches, "match_type", "count"),
        "avg_score_by_type": stats.mean_score_by(matches, "match_type", "similarity_score"),
        "matches_by_framework": stats.counts_by(matches, "framework", "count"),
        "matches_by_project": stats.counts_by(matches, "project", "count"),
        "newly_defined_patterns_occurrence": stats.watch_list(matches, watched).withColumnsRenamed(
            {"pattern": "Pattern", "matches": "Matches"}),
        "source_pattern_analysis": stats.source_table(matches).withColumnsRenamed(
            {"total_matches": "Total Matches", "source_framework_names": "Source Frameworks"}),
        "adoption_pattern_analysis": stats.adoption_table(matches).drop("total_matches").withColumnsRenamed(
            {"target_project_coverage": "Project Coverage", "target_project_names": "Found In Projects"}),
        "patterns_by_match_count": stats.counts_by(with_pattern, "pattern", "count"),
        "avg_score_by_pattern": stats.mean_score_by(with_pattern, "pattern", "similarity_score"),
        "top_matched_concepts": stats.top_concepts(matches).drop("concept_name"),
        "unmatched_patterns": stats.unmatched_patterns(matches, defined).withColumnRenamed(
            "pattern", "unmatched_patterns"),
    }


# Tables written only when some match carries a pattern (fixed values).
NEEDS_PATTERNS = {
    "newly_defined_patterns_occurrence", "source_pattern_analysis", "adoption_pattern_analysis",
    "patterns_by_match_count", "avg_score_by_pattern",
}


def write_report(matches: DataFrame, defined: DataFrame, watched: DataFrame, folder: str) -> list[str]:
    """Write every table that has content; the per-framework tables are one partitioned write.

    The matches are read once: all tables are made from the matches counted by ``stats.GRAIN``.
    """
    seen = Observation()
    base = stats.base(matches.observe(seen, F.count_if(tx.to_null(F.col("pattern")).isNotNull()).alias("patterns")))
    any_pattern = seen.get["patterns"] > 0
    written = []
    for name, table in report_tables(base, defined, watched).items():
        if name in NEEDS_PATTERNS and not any_pattern:
            continue
        rows = Observation()
        _csv(table.observe(rows, F.count("*").alias("n")), f"{folder}/{name}")
        # an empty table stays in the folder, so that nothing of an earlier run is left there, but is not reported
        if name != "unmatched_patterns" or rows.get["n"]:
            written.append(name)
    if any_pattern:
        per_framework = stats.patterns_in_frameworks(base).select(
            F.lower("framework").alias("framework"), "pattern", F.col("matches").alias("count"))
        per_framework.write.mode("overwrite").partitionBy("framework").options(**CSV).csv(
            f"{folder}/patterns_in_frameworks")
        written.append("patterns_in_frameworks")
    return written


def language_json(distribution: DataFrame, queries: list[str], timestamp: str) -> DataFrame:
    """One JSON document ``{meta, distribution}``; one map entry per language."""
    entry = F.struct(F.col("language"), F.col("repos"))
    by_count = F.sort_array(F.collect_list(F.struct(F.col("repos").alias("n"), entry.alias("e"))), asc=False)
    doc = distribution.agg(F.sum("repos").alias("total"), by_count.alias("langs"))
    return doc.select(F.to_json(F.struct(
        F.struct(F.col("total").alias("total_repos"), F.array(*[F.lit(q) for q in queries]).alias("queries"),
                 F.lit(timestamp).alias("timestamp")).alias("meta"),
        F.map_from_entries(F.transform("langs", lambda x: x["e"])).alias("distribution"),
    )).alias("value"))


def write_language_json(distribution: DataFrame, path: str, queries: list[str], timestamp: str) -> None:
    language_json(distribution, queries, timestamp).write.mode("overwrite").text(path)


def write_repositories(top: DataFrame, folder: str) -> None:
    """The ranked list as JSON rows and its names as text, both in rank order."""
    ordered = repos.ranked_output(top).orderBy("rank")
    ordered.write.mode("overwrite").json(f"{folder}/ranked")
    ordered.select("full_name").write.mode("overwrite").text(f"{folder}/names")


def write_languages(distribution: DataFrame, path: str) -> None:
    _csv(repos.ranked_languages(distribution), path)


def concept_table(concepts: DataFrame) -> DataFrame:
    """Markdown rows of a concept list."""
    return concepts.select(tx.markdown_row(F.col("name"), F.col("summary")).alias("row"))


def coverage_tables(uses: DataFrame, base: DataFrame) -> dict[str, DataFrame]:
    return {
        "coverage": coverage.coverage(uses, base),
        "pattern_counts": coverage.pattern_counts(uses),
        "pattern_sources": coverage.pattern_sources(uses),
        "missing_and_extra": coverage.missing_and_extra(uses, base),
        "extra_pattern_sources": coverage.extra_pattern_sources(uses, base),
    }
