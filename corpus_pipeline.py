"""The corpus pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, all but the last
with the columns of documents. ``run`` applies them one after the other; what a stage
returns is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from conceptmine.llm import decontaminate, ngram_join, packing, rows, suffix_dedup, toxicity
from conceptmine.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject."""
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), keep=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest id and text hash."""
    groups = materialize(ngram_join.similar_groups(docs, n=5, num=80, den=100, count_links=False).select("doc_id", "text_hash", "kept"))
    return rows.one_per_group(docs, groups)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that an earlier place has."""
    return suffix_dedup.remove_repeats(docs, n_chars="n_chars")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated texts without their benchmark passages."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), n_chars="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("best_fit_packing", pack),
]

#: No SQL expresses the fitted model of the first stage; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = rows.written(docs)
    return docs
