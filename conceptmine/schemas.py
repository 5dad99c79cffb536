"""Explicit schemas; nothing in this package infers types from data."""

from pyspark.sql import types as T

CONCEPT = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("docstring", T.StringType()),
    T.StructField("source_code", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("is_target_subclass", T.BooleanType()),
    T.StructField("base_classes", T.ArrayType(T.StringType())),
])

KNOWLEDGE_BASE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("pattern", T.StringType()),
])

MATCH = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("concept_name", T.StringType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("match_type", T.StringType()),
    T.StructField("matched_text", T.StringType()),
    T.StructField("similarity_score", T.StringType()),
])

# The same table where scores are numbers already.
MATCH_TABLE = T.StructType([*MATCH.fields[:-1], T.StructField("similarity_score", T.DoubleType())])

CATALOGUE_FIELDS = ["name", "intent", "alias", "context", "forces", "solution", "result"]
CATALOGUE = T.StructType([T.StructField(f, T.StringType()) for f in CATALOGUE_FIELDS])

REPOSITORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("stargazers_count", T.LongType()),
    T.StructField("forks_count", T.LongType()),
    T.StructField("contributors_count", T.LongType()),
    T.StructField("contributors_status", T.IntegerType()),
    T.StructField("pushed_at", T.TimestampType()),
    T.StructField("archived", T.BooleanType()),
    T.StructField("fork", T.BooleanType()),
    T.StructField("language", T.StringType()),
    T.StructField("html_url", T.StringType()),
])

LANGUAGE_DISTRIBUTION = T.StructType([
    T.StructField("meta", T.StructType([
        T.StructField("total_repos", T.LongType()),
        T.StructField("queries", T.ArrayType(T.StringType())),
        T.StructField("timestamp", T.StringType()),
    ])),
    T.StructField("distribution", T.MapType(T.StringType(), T.LongType())),
])
