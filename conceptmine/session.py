"""Spark session defaults and the durable cut of long lineages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on; everything else is left to the cluster.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # vectors are wide: small Arrow batches keep Python workers flat
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_session(app: str = "conceptmine", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the package defaults; ``master`` is only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a folder in the session's warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/conceptmine-shared"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; ``drop_scratch`` removes it."""
    path = f"{shared_dir(spark)}/conceptmine-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_conceptmine_scratch", []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Remove the tables this application has written to the shared folder so far, and say how many.

    For the end of a flow, when its results are stored elsewhere: results that are still to be computed read them.
    """
    paths = spark.sparkContext.__dict__.get("_conceptmine_scratch", [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        gone += path.getFileSystem(conf).delete(path, True)
    return gone


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a Parquet table to the shared folder and read it back.

    Computed once (an eager checkpoint computes twice), survives lost
    executors, and later reads prune columns and know their size.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, tasks: int | None) -> DataFrame:
    """Deal the rows to ``tasks`` tasks before heavy work on each; None leaves them as they come.

    For callers that know their scan has fewer splits than cores, as a small file has.
    """
    return df if tasks is None else df.repartition(tasks)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (what ``--py-files`` does), once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_conceptmine_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="conceptmine-code-")) / "conceptmine_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(here.rglob("*.py")):
            z.write(source, source.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._conceptmine_shipped = True
