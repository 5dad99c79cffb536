"""The three flows: mine concepts, match scripts, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.operators import code, dedup, lookup
from conceptmine.operators.encode import EncoderStage, encode_distinct, text_key, with_vectors
from conceptmine.operators.ranking import numbered
from conceptmine.operators.similarity import similarity_join
from conceptmine.operators.skew import salted_join
from conceptmine.session import materialize

Encode = Callable[[Column], Column] | EncoderStage

NAME_THRESHOLD = 0.90
SUMMARY_THRESHOLD = 0.65
DEDUP_THRESHOLD = 0.95


AUDIT = "removed string, kept string, similarity string, removed_summary string, kept_summary string"


def mine(files: DataFrame, profile: code.Profile, encode: Encode | None = None, threshold: float = DEDUP_THRESHOLD,
         api_names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SDK files to the concepts of a framework, unique by name and with their order ``ord``, plus an audit.

    A profile with ``dedup`` also loses wrappers and, by the vectors of ``encode``, near copies; the audit has
    one row for each of these. One with ``api_functions`` is limited to ``api_names(name)``.
    """
    raw = materialize(code.extract_concepts_ordered(files, profile, api_names))
    order = [F.col("dir_rank"), F.split("path", "/"), F.col("pos")]
    if not profile.dedup:
        return numbered(raw, order, "ord", start=0), files.sparkSession.createDataFrame([], AUDIT)
    if encode is None:
        raise ValueError("this profile needs an encoder")
    ordered = numbered(dedup.drop_wrappers(raw, profile.prefix), order, "ord", start=0)
    keyed = ordered.withColumn("key", text_key(F.col("summary")))
    vectors = encode_distinct(ordered, "summary", encode).select("key", "vec")
    encoded = materialize(salted_join(keyed, vectors, "key").drop("key"))
    return dedup.semantic_dedup(encoded, threshold)


def _hits(texts: DataFrame, key: str, concepts: DataFrame, concept_text: str, encode: Encode, threshold: float) -> DataFrame:
    """``(key, name, pattern, similarity_score)`` of encoded texts; every concept text is encoded once."""
    targets = materialize(encode_distinct(concepts, concept_text, encode).select("key", "vec"))
    pairs = similarity_join(texts, targets, threshold, left_key=key, right_key="key").select(
        F.col("left_id").alias(key), F.col("right_id").alias("concept_key"), F.col("score").alias("similarity_score"))
    named = concepts.select(text_key(F.col(concept_text)).alias("concept_key"), "name", "pattern")
    # many concepts may share a text
    return salted_join(materialize(named), pairs, "concept_key").drop("concept_key")


def match(scripts: DataFrame, resolved: DataFrame, encode: Encode, name_threshold: float = NAME_THRESHOLD,
          summary_threshold: float = SUMMARY_THRESHOLD) -> DataFrame:
    """Scripts ``(path, text)`` and resolved concepts to the match table.

    The corpus is read and parsed once. Names are short and repeat, so they are counted and
    encoded once each; comment blocks are long and encoded where they are. What moves of a
    block is its vector and the part that is shown.
    """
    resolved = materialize(resolved)
    # a null vector stands for the block of a script without comments
    parsed = scripts.select("path", code.callees(F.col("text")).alias("elements"), F.nullif(
        tx.comment_block(F.col("text")), F.lit("")).alias("block"))
    features = materialize(with_vectors(parsed, "block", encode).select(
        F.monotonically_increasing_id().alias("script"), "path", "elements", "vec",
        tx.truncated_comment(F.col("block")).alias("shown")))

    calls = features.select("path", F.explode("elements").alias("element"))
    names = materialize(with_vectors(calls.groupBy("element").agg(F.count("*").alias("_n")), "element", encode))
    # a few names ('print', 'range') are used by very many files
    by_name = salted_join(calls, _hits(names, "element", resolved, "short_name", encode, name_threshold), "element",
                          counts=names.select("element", "_n")).withColumnRenamed("element", "matched_text")

    blocks = features.where(F.col("vec").isNotNull())
    found = _hits(blocks, "script", resolved, "summary", encode, summary_threshold)
    by_summary = blocks.select("script", "path", F.col("shown").alias("matched_text")).join(found, "script")

    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(
            F.col("path").alias("file_path"), F.col("name").alias("concept_name"), "pattern",
            F.lit(kind).alias("match_type"), "matched_text", "similarity_score")

    return rows(by_name, "name").unionByName(rows(by_summary, "summary"))


def label(concepts: DataFrame, kb: DataFrame) -> DataFrame:
    return lookup.resolve_patterns(concepts, lookup.pattern_map(kb))
