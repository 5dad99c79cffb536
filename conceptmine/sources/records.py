"""Records of quoted text tables, one file read by many tasks.

Quoted fields may hold line ends, so a split of such a file does not know whether it begins
inside a field. It does once the quotes before it are counted: after an odd number the split
begins inside. The first pass counts quotes by split; the second cuts records, and what a
split has of records begun before it or ended after it is put together by their first split.

Every quote must belong to a quoted field, as writers see to (a quote in a field is doubled
there and the field quoted); a stray one in a bare field would shift all that follow in its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SPLIT = ["file", "split"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in file order within a task, with the file and the start of the split they come from."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def _begun(lines: DataFrame, quote: str) -> DataFrame:
    """Splits that begin inside a record, with the split in which that record begins."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, ends = None, 0, [False, False]
        for batch in batches:
            out = []
            odd = pc.count_substring(batch.column(2), quote).to_numpy() % 2 == 1
            for key, o in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), odd.tolist()):
                if key != now:
                    out += [(*now, n, *ends)] if now else []
                    now, n, ends = key, 0, [False, False]
                n ^= o
                ends[n] = True
            yield rows(out)
        yield rows([(*now, n, *ends)] if now else [])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [*_SPLIT, "n", "even_end", "odd_end"])

    # by split: the parity of its quotes, and whether lines end after an even and after an odd number of them
    counted = lines.mapInArrow(count, "file string, split long, n long, even_end boolean, odd_end boolean")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1)
    # a record that is open at the end of such a split began in it
    fresh = ~F.col("inside") | F.col("odd_end")
    return placed.withColumn("from", F.last(F.when(fresh, F.col("split")), ignorenulls=True).over(before)).where(
        "inside").select(*_SPLIT, "from")


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(first, record)``: the records of all files at ``path``; ``first`` marks the first one of its file.

    Blank lines outside quotes are no records; one line end after a record goes.
    """
    lines = _lines(spark, path)
    # one row per split that begins inside a record
    rows = lines.join(F.broadcast(_begun(lines, quote)), _SPLIT, "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, from_, held, odd, first = None, None, [], False, False

        def part(ended: bool) -> tuple:
            """What is held: a record, or the part of one that this split has."""
            return now[0], now[1] if from_ is None else from_, now[1], "\n".join(held), first, ended and from_ is None

        for batch in batches:
            out = []
            quotes = pc.count_substring(batch.column(2), quote).to_numpy() % 2 == 1
            for f, s, text, b, n in zip(*(batch.column(i).to_pylist() for i in range(4)), quotes.tolist()):
                if (f, s) != now:
                    out += [part(False)] if held else []
                    now, from_, held, odd, first = (f, s), b, [], b is not None, s == 0
                held.append(text)
                odd ^= n
                if not odd:
                    out.append(part(True))
                    first &= not held[0].strip("\r")  # a blank line is no record
                    from_, held = None, []
            yield rows_of(out)
        yield rows_of([part(False)] if held else [])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = {"file": pa.string(), "from": pa.int64(), "at": pa.int64(), "record": pa.string(), "first": pa.bool_(), "whole": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds.values())], list(kinds))

    parts = rows.select(*_SPLIT, "line", "from").mapInArrow(
        cut, "file string, from long, at long, record string, first boolean, whole boolean")
    # at most two parts a split
    pieces = F.array_sort(F.collect_list(F.struct("at", "record")))
    joined = parts.where("NOT whole").groupBy("file", "from").agg(
        F.bool_or("first").alias("first"), F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
    both = parts.where("whole").select("first", "record").unionByName(joined.select("first", "record"))
    return both.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.col("record") != "")


def read_quoted(spark: SparkSession, path: str, schema: StructType, sep: str = ",", header: bool = True, quote: str = '"') -> DataFrame:
    """A quoted text table by position, as ``spark.read.csv`` with ``multiLine`` gives it; ``header``: each file has a head line."""
    records = quoted_records(spark, path, quote)
    if header:
        records = records.where("NOT first")
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true", "mode": "PERMISSIVE"}
    return records.select(F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                                     options).alias("r")).select("r.*")
