"""Continuous notebook conversion: new and changed notebook files become scripts.

A file stream forgets nothing: a changed file under an old name is not read again. So the stream
runs over file *versions* instead. ``snapshot`` lists the folder (no contents) and appends the versions
it has not listed before to a table; the stream reads that table, keeps each version (path and
time) once in its state, and converts the files behind the new ones. What a run writes is one
batch folder, written anew if the batch has to be run again, so a restart adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from conceptmine.operators.ranking import last_wins
from conceptmine.sources.notebooks import convert
from conceptmine.sources.scan import list_files, path_exists, scan_notebooks

VERSION = "path string, modified timestamp"
SCRIPT = "path string, modified timestamp, text string"


def snapshot(spark: SparkSession, root: str, versions: str, glob: str = "*.ipynb") -> None:
    """Append the file versions below ``root`` that ``versions`` does not have; contents are not read."""
    now = list_files(spark, root, glob).select("path", "modified")
    if path_exists(spark, versions):
        known = spark.read.schema(VERSION).parquet(versions)
        now = now.join(known, ["path", "modified"], "left_anti")
    now.write.mode("append").parquet(versions)


def start_conversion(spark: SparkSession, root: str, out: str, checkpoint: str, glob: str = "*.ipynb") -> StreamingQuery:
    """Convert what is new or changed since the last run and stop; run it again for more.

    ``out`` gets one folder a batch; ``scripts`` gives the newest text of each path. A notebook
    that cannot be read as one has no script.
    """
    versions = f"{checkpoint}/versions"
    snapshot(spark, root, versions, glob)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.select("path", "modified")
        since = batch.agg(F.min("modified")).first()[0]
        if since is None:
            return
        # files that are older than every new version are not opened
        files = scan_notebooks(batch.sparkSession, root, glob=glob, since=since)
        fresh = files.join(batch, ["path", "modified"], "left_semi").select("path", "modified", "text")
        scripts_ = convert(fresh).where(F.col("text").isNotNull()).select("path", "modified", "text")
        scripts_.write.mode("overwrite").parquet(f"{out}/batch={number}")

    seen = spark.readStream.schema(VERSION).parquet(versions).dropDuplicates(["path", "modified"])
    return (
        seen.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream")
        .trigger(availableNow=True).start()
    )


def scripts(spark: SparkSession, out: str) -> DataFrame:
    """``(path, modified, text)``: the newest script of each notebook."""
    written = spark.read.schema(SCRIPT + ", batch long").option("basePath", out).parquet(out)
    return last_wins(written, ["path"], [F.col("modified"), F.col("batch")]).drop("batch")
