"""File scans: scripts, SDK modules and notebooks as ``(path, project, text)``.

Folders of a local or mounted file system are listed and read by tasks, so the driver holds nothing per
file. On other file systems Spark's own reader does both; it keeps a list of all files on the driver.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from conceptmine.functions import text as tx


# A well-formed UTF-8 sequence, or a run of ASCII, each byte as the character of its number; and any byte else.
_BYTES = (r"([\x00-\x7F]+|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]"
          r"|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2})|[\x80-\xFF]")


def is_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def decode_strict(content: Column) -> Column:
    """UTF-8 text with ``\\n`` line ends; null where the bytes are none."""
    return F.when(is_utf8(content), F.regexp_replace(content.cast("string"), "\r\n?", "\n"))


def decode_lenient(content: Column) -> Column:
    """UTF-8 text with bad bytes dropped (``cast`` would keep them) and ``\\n`` line ends.

    Built-in expressions only: a worker process for each task would cost more than its few small files.
    """
    good = F.regexp_replace(F.decode(content, "ISO-8859-1"), _BYTES, "$1")
    mended = F.encode(F.when(~is_utf8(content), good), "ISO-8859-1")
    return F.coalesce(decode_strict(content), F.regexp_replace(mended.cast("string"), "\r\n?", "\n"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system its scheme names."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return False
        raise


# Folders that the driver names at each level of a tree, and entries it looks at in one of them.
_STARTS, _LOOK = 64, 10_000
# Files and bytes of the batches in which contents come.
_BATCH_FILES, _BATCH_BYTES = 1000, 4 << 20
_LISTED = "path string, modified timestamp, length bigint"


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on disk behind ``path``, None if it is on another file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.makeQualified(place).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def _hidden(name: str, folder: bool) -> bool:
    """Names that Spark's readers leave out."""
    marked = name.startswith(".") or (name.startswith("_") and "=" not in name)
    if folder and name.startswith(("_common_metadata", "_metadata")):
        return False
    return marked or name.endswith("._COPYING_")


def _entries(folder: str, skip: frozenset[str]) -> Iterator[tuple[os.DirEntry, bool]]:
    """What a scan sees in a folder, and whether it is a folder itself; nothing in one that is gone."""
    try:
        inside = os.scandir(folder)
    except (FileNotFoundError, NotADirectoryError):
        return
    with inside:
        for entry in inside:
            is_folder = entry.is_dir()
            if entry.name not in skip and not _hidden(entry.name, is_folder):
                yield entry, is_folder


def _starts(root: str, skip: frozenset[str]) -> list[tuple[str, bool]]:
    """Folders, relative to ``root``, that hold all its files: each alone, or (true) with those below it."""
    starts, level = [], [""]
    while level and len(level) < _STARTS:
        below = []
        for folder in level:
            inside = list(islice(_entries(os.path.join(root, folder), skip), _LOOK))
            folders = [os.path.join(folder, entry.name) for entry, is_folder in inside if is_folder]
            # one with more in it than is looked at goes to a task whole
            deep = len(inside) == _LOOK or len(folders) > _STARTS
            starts.append((folder, deep))
            below += [] if deep else folders
        level = below
    return starts + [(folder, True) for folder in level]


def _list_local(spark: SparkSession, root: str, glob: str, skip_dirs: list[str] | None) -> DataFrame:
    skip = frozenset(skip_dirs or ())
    wanted = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()

    def rows(start: str, deep: bool) -> Iterator[tuple[str, int, int]]:
        fits, todo = re.compile(wanted, re.DOTALL), [start]
        while todo:
            folder = todo.pop()
            for entry, is_folder in _entries(os.path.join(root, folder), skip):
                path = os.path.join(folder, entry.name)
                if is_folder:
                    todo += [path] * deep
                elif fits.fullmatch(entry.name) and _encodes(entry.name):
                    try:
                        info = entry.stat()
                    except FileNotFoundError:
                        continue
                    if info.st_size:
                        yield path, info.st_mtime_ns // 1_000_000 * 1000, info.st_size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, deep in zip(*(c.to_pylist() for c in batch.columns)):
                found = rows(start, deep)
                while some := list(islice(found, 10_000)):
                    path, modified, length = zip(*some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(path), pa.array(modified, pa.timestamp("us", "UTC")), pa.array(length, pa.int64())],
                        ["path", "modified", "length"])

    return spark.createDataFrame(_starts(root, skip), "folder string, deep boolean").mapInArrow(run, _LISTED)


def _encodes(name: str) -> bool:
    """Whether a name is text; others cannot be told apart once they are."""
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def _read_local(files: DataFrame, root: str) -> DataFrame:
    """``content`` of listed files; those that cannot be read are left out."""
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        path, modified, content = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(path), pa.array(modified, pa.timestamp("us", "UTC")), pa.array(content, pa.binary())], ["path", "modified", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for listed in batches:
            times = listed.column("modified").cast(pa.int64()).to_pylist()
            for path, modified in zip(listed.column("path").to_pylist(), times):
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        content = file.read()
                except OSError:
                    continue
                if held and (len(held) == _BATCH_FILES or size + len(content) > _BATCH_BYTES):
                    yield batch(held)
                    held, size = [], 0
                held.append((path, modified, content))
                size += len(content)
        if held:
            yield batch(held)

    # a folder can hold most of the files: they are dealt out by path
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(tasks, "path").mapInArrow(run, "path string, modified timestamp, content binary")


def _spark_files(spark: SparkSession, root: str, glob: str, skip_dirs: list[str] | None) -> DataFrame:
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true")
        .load(root)
    )
    # binaryFile gives file:/a/b.py; keep what follows the root folder
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    full = F.regexp_replace("path", "^[a-zA-Z0-9]+:(//[^/]*)?", "")
    anchor = base if base.startswith("/") else "/" + base
    rel = F.element_at(F.split(full, "^.*?" + _quote(anchor), 2), 2)
    out = raw.select(rel.alias("path"), F.col("modificationTime").alias("modified"), "length", "content").where("length > 0")
    if skip_dirs:
        banned = F.array(*[F.lit(d) for d in skip_dirs])
        out = out.where(~F.arrays_overlap(F.split("path", "/"), banned))
    return out


def list_files(spark: SparkSession, root: str, glob: str, skip_dirs: list[str] | None = None) -> DataFrame:
    """Files below ``root`` that are not empty: ``path`` relative to it, ``modified``, ``length``; contents are not read."""
    local = local_path(spark, root)
    if local is not None and os.path.isdir(local):
        return _list_local(spark, local, glob, skip_dirs)
    return _spark_files(spark, root, glob, skip_dirs).drop("content")


def scan_files(spark: SparkSession, root: str, glob: str, skip_dirs: list[str] | None = None,
               since: dt.datetime | None = None) -> DataFrame:
    """Files below ``root``: ``path`` relative to it, ``modified``, ``content``. Those older than ``since`` are not opened."""
    def recent(files: DataFrame) -> DataFrame:
        return files if since is None else files.where(F.col("modified") >= F.lit(since))

    local = local_path(spark, root)
    if local is not None and os.path.isdir(local):
        return _read_local(recent(_list_local(spark, local, glob, skip_dirs)), local)
    return recent(_spark_files(spark, root, glob, skip_dirs)).drop("length")


def _quote(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def scan_scripts(spark: SparkSession, root: str, skip_dirs: list[str] | None = None, glob: str = "*.py",
                 strict: bool = False, seen: Observation | None = None) -> DataFrame:
    """Every script below ``root``: ``(path, project, text)``.

    ``strict`` leaves out files that are no UTF-8, as modules of an SDK are; otherwise their bad bytes
    go. ``seen`` gets ``files`` that could be read and ``bad`` ones among them when the rows are
    used; ``unreadable`` compares that with what is there.
    """
    files = scan_files(spark, root, glob, skip_dirs)
    if seen is not None:
        files = files.observe(seen, F.count("*").alias("files"), F.count_if(~is_utf8(F.col("content"))).alias("bad"))
    text = decode_strict(F.col("content")) if strict else decode_lenient(F.col("content"))
    scripts = files.select("path", tx.project_of(F.col("path")).alias("project"), text.alias("text"))
    return scripts.where(F.col("text").isNotNull()) if strict else scripts


def unreadable(spark: SparkSession, root: str, glob: str, seen: Observation) -> int:
    """Files below ``root`` that a scan with ``seen`` and without skipped folders had to leave out.

    Contents are not read; files without any are in no scan.
    """
    return list_files(spark, root, glob).count() - seen.get["files"]


def scan_notebooks(spark: SparkSession, root: str, skip_dirs: list[str] | None = None, glob: str = "*.ipynb",
                   since: dt.datetime | None = None) -> DataFrame:
    """Every notebook below ``root``, or every one not older than ``since``: ``(path, project, modified, text)``."""
    files = scan_files(spark, root, glob, skip_dirs, since)
    return files.select("path", tx.project_of(F.col("path")).alias("project"), "modified",
                        decode_lenient(F.col("content")).alias("text"))


def projects(files: DataFrame) -> DataFrame:
    """First-level folders that hold at least one scanned file."""
    inside = F.contains("path", F.lit("/"))
    return files.where(inside).select(tx.project_of(F.col("path")).alias("project")).distinct()


def notebook_counts(files: DataFrame) -> DataFrame:
    """Notebooks found per project."""
    return files.groupBy(tx.project_of(F.col("path")).alias("project")).agg(
        F.count("*").alias("notebooks"))
