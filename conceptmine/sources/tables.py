"""Readers of the tables the jobs work on; every schema is explicit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptmine import schemas
from conceptmine.functions import text as tx
from conceptmine.sources.records import read_quoted
from conceptmine.sources.scan import path_exists

# Quotes are doubled inside quoted fields and fields may span lines.
CSV = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def _csv(spark: SparkSession, path: str, schema, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=header, enforceSchema=True, **CSV)


def read_knowledge_base(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """``{framework: path}`` to ``(framework, file_no, ord, name, summary, pattern)``.

    Columns count by position, rows without a third field are dropped and a
    missing file is skipped. ``ord`` grows with the row's place in its file.
    """
    parts = []
    for file_no, (framework, path) in enumerate(sources.items()):
        if not path_exists(spark, path):
            continue
        rows = _csv(spark, path, schemas.KNOWLEDGE_BASE).select(
            F.lit(framework).alias("framework"), F.lit(file_no).alias("file_no"),
            F.monotonically_increasing_id().alias("ord"),
            tx.strip(F.col("name")).alias("name"), "summary", tx.strip(F.col("pattern")).alias("pattern"))
        parts.append(rows.where(F.col("pattern").isNotNull()))
    if not parts:
        raise FileNotFoundError("no knowledge-base file found")
    return reduce(DataFrame.unionByName, parts)


def pattern_names(kb: DataFrame) -> DataFrame:
    """Distinct non-empty pattern names of a knowledge base."""
    return kb.select(tx.strip(F.col("pattern")).alias("pattern")).where(F.col("pattern") != "").distinct()


def read_pattern_list(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """One-column list of pattern names, with or without a header line."""
    rows = _csv(spark, path, "pattern string", header=header)
    return pattern_names(rows)


def read_pattern_column(spark: SparkSession, path: str, column: str = "pattern") -> DataFrame:
    """Pattern names of a table whose header names the column, wherever it stands."""
    rows = spark.read.csv(path, header=True, inferSchema=False, **CSV)
    return pattern_names(rows.select(F.col(column).alias("pattern")))


def read_concepts_json(spark: SparkSession, paths: list[str], lines: bool = False) -> DataFrame:
    """Concept arrays in JSON, or one concept a line as ``write_concepts_json`` leaves them; rows lacking a name or a summary are dropped."""
    found = [p for p in paths if path_exists(spark, p)]
    if not found:
        return spark.createDataFrame([], schemas.CONCEPT)
    rows = spark.read.schema(schemas.CONCEPT).json(found, multiLine=not lines)
    return rows.where(F.col("name").isNotNull() & F.col("summary").isNotNull())


def read_concepts_csv(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """``{framework: (path, delimiter)}`` to ``(framework, name, summary)``."""
    parts = [
        _csv(spark, path, "name string, summary string", sep=sep)
        .select(F.lit(framework).alias("framework"), "name", "summary")
        for framework, (path, sep) in sources.items() if path_exists(spark, path)
    ]
    if not parts:
        return spark.createDataFrame([], "framework string, name string, summary string")
    return reduce(DataFrame.unionByName, parts)


def with_origin(matches: DataFrame) -> DataFrame:
    """Adds ``framework`` and ``project``, makes scores numeric and 'N/A' patterns null."""
    return (
        matches
        .withColumn("similarity_score", F.expr("try_cast(similarity_score AS DOUBLE)"))
        .withColumn("pattern", tx.to_null(F.col("pattern")))
        .withColumn("framework", tx.framework_of(F.col("concept_name")))
        .withColumn("project", tx.project_of(F.col("file_path")))
    )


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """The ``;`` match table, each file read by as many tasks as it has splits; a missing or empty one is an error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"match table not found: {path}")
    if spark.read.text(path).isEmpty():
        raise ValueError(f"match table is empty: {path}")
    return with_origin(read_quoted(spark, path, schemas.MATCH, sep=";"))


def read_match_table(spark: SparkSession, path: str) -> DataFrame:
    """The match table in Parquet, the form that jobs pass on; a missing one is an error."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"match table not found: {path}")
    return with_origin(spark.read.schema(schemas.MATCH_TABLE).parquet(path))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOGUE).json(path, multiLine=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-blank lines of a text file."""
    return spark.read.text(path).select(tx.strip(F.col("value")).alias("value")).where(F.col("value") != "")


def latest_file(spark: SparkSession, folder: str, glob: str) -> str | None:
    """Path of the newest file by modification time; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()["path"]


def read_language_distribution(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.LANGUAGE_DISTRIBUTION).json(path, multiLine=True)
    return rows.select("meta.total_repos", "meta.timestamp",
                       F.explode("distribution").alias("language", "repos"))


def read_ratings(spark: SparkSession, path: str, raters: list[str]) -> DataFrame:
    return _csv(spark, path, ", ".join(f"`{r}` string" for r in raters))


def read_repositories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REPOSITORY).json(path)
