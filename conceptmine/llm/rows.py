"""Leaving out rows of a wide table by a table of ids, moving only the rows that may be concerned.

Defined results: null ids and texts are values like others; an empty table stays empty; a
table may have columns of any names, those of ``groups`` and of this module included.
"""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptmine.llm.keyset import key_set
from conceptmine.session import materialize

#: Rows and bytes of the Arrow batches of texts: a task holds a few of them, in the JVM and in its worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started inside send their rows to Python in batches of bounded size; the session's settings come back after."""
    small = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """``materialize``, with texts in small batches."""
    with small_batches(df.sparkSession):
        return materialize(df)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to be no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def may_be_in(some: Broadcast):
    """Whether a 64-bit hash may be in a broadcast key set. Workers get the hashes only, wide rows stay in the JVM."""
    @F.arrow_udf("boolean")
    def look(hashes: pa.Array) -> pa.Array:
        return pa.array(some.value.maybe(hashes.to_numpy()))

    return look


def one_per_group(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group the document that is kept; repeated rows of one id and text are one document.

    ``groups`` has ``doc_id``, ``text_hash`` and ``kept`` of every row; it must be a written table. Rows go
    by id and text, so other texts of the same id, or without one, stay.
    """
    gone = groups.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    twice = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    some = docs.sparkSession.sparkContext.broadcast(
        key_set(gone.select("doc_id").union(twice).select(F.xxhash64("doc_id").alias("k")), "k"))
    id_hash, text_hash, concerned = (free_name(docs, c) for c in ("_id_hash", "_text_hash", "_concerned"))

    hashed = docs.withColumn(id_hash, F.xxhash64(F.col(f"`{doc_id}`"))).withColumn(concerned, may_be_in(some)(id_hash))
    columns = [f"`{c}`" for c in docs.columns]
    plain = hashed.where(~F.col(concerned)).select(*columns)
    maybe = hashed.where(F.col(concerned)).withColumn(text_hash, F.xxhash64(F.col(f"`{text}`")))
    maybe = maybe.dropDuplicates([id_hash, text_hash])
    same = F.col(f"d.`{doc_id}`").eqNullSafe(F.col("g.doc_id")) & F.col(f"d.`{text_hash}`").eqNullSafe(F.col("g.text_hash"))
    left = maybe.alias("d").join(gone.alias("g"), same, "left_anti")
    return plain.union(left.select(*columns))
