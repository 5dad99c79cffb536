"""Text to vector. The encoder is the caller's; it sees each distinct text once."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Builds an encoder: called once per task, then applied batch by batch.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def ngram_encoder(dim: int = 256, n: int = 3) -> EncoderFactory:
    """Deterministic default: hashed character n-gram counts, length one."""
    def build():
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                padded = f"^{text.lower()}$"
                grams = {padded[i:i + n].encode() for i in range(max(1, len(padded) - n + 1))}
                np.add.at(out[row], [zlib.crc32(g) % dim for g in grams], 1.0)
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(length > 0, length, 1)
        return encode
    return build


def _encoded(texts: pa.Array, model: Callable[[list[str]], np.ndarray]) -> pa.Array:
    """Vectors of an array of texts; nulls stay null."""
    have = texts.is_valid().to_numpy(zero_copy_only=False)
    if not have.any():
        return pa.nulls(len(texts), pa.list_(pa.float32()))
    vectors = np.ascontiguousarray(model(texts.drop_null().to_pylist()), dtype=np.float32)
    ends = np.r_[0, np.cumsum(have) * vectors.shape[1]].astype(np.int32)
    return pa.ListArray.from_arrays(ends, vectors.ravel(), mask=pa.array(~have))


def encoder_column(factory: EncoderFactory) -> Callable[[Column], Column]:
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for texts in batches:
            yield _encoded(texts, model)
    return encode


class EncoderStage:
    """An encoder that runs as a stage of its own, for a model that wants other resources than the rest of a job.

    ``profile`` is a resource profile (GPUs, memory) for the executors of that stage; the rows go
    through it in place, so no text is moved to another task.
    """

    def __init__(self, factory: EncoderFactory, profile: ResourceProfile | None = None, batch: int = 256):
        self.factory, self.profile, self.batch = factory, profile, batch

    def rows(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with the vectors of ``text`` as ``vec``; a null text has none."""
        factory, step, place = self.factory, self.batch, df.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = None
            for batch in batches:
                model = model or factory()
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, _encoded(part.column(place), model)], [*part.schema.names, "vec"])

        schema = T.StructType([*df.schema.fields, T.StructField("vec", T.ArrayType(T.FloatType()))])
        return df.mapInArrow(run, schema, profile=self.profile)


def with_vectors(df: DataFrame, text: str, encode: Callable[[Column], Column] | EncoderStage) -> DataFrame:
    """``df`` with the vectors of ``text`` as ``vec``; texts stay in the task they are in."""
    return encode.rows(df, text) if isinstance(encode, EncoderStage) else df.withColumn("vec", encode(F.col(text)))


def text_key(c: Column) -> Column:
    """Short join key of a text, so long texts are shuffled once and not per match."""
    return F.sha2(c, 256)


def encode_distinct(texts: DataFrame, text: str, encode: Callable[[Column], Column] | EncoderStage) -> DataFrame:
    """``(key, text, vec)``, one row per distinct non-null text.

    The grouping combines on the map side, so a text repeated in a third of all
    rows is encoded once.
    """
    present = texts.select(F.col(text).alias("text")).where(F.col("text").isNotNull())
    distinct = present.groupBy(text_key(F.col("text")).alias("key")).agg(F.any_value("text").alias("text"))
    return with_vectors(distinct, "text", encode)
