"""Quality rules with the cross-document frequency of lines.

Base counts come from the text alone. Then normalised lines (lower-case words) are
hashed, the distinct documents of a host with the line are counted, lines above the
host's limit are removed, and documents that lose most of their words are rejected.
Exact copies of a text on a host count as one document: they say nothing about a line.

Defined results: one row per input row, also for repeated rows and ids; a null text has
no words and fails the base rule, so it is not kept; a null host is a host of its own;
an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.llm import vec
from conceptmine.session import materialize

MIN_WORDS = 50
#: Base rule: share of words in repeated 3-word windows, in percent.
REPEAT_PERCENT = 50
#: A line is removed from this share of its host's documents on, and from this many at least.
LINE_SHARE, LINE_DOCS = 0.005, 10
#: A document is depleted with less than this share of its words left.
LEFT_SHARE = 0.5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_NO_LINE_END = np.arange(256) != 10
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _keyed(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each (text, hash) pair, and how often each number occurs."""
    _, number, times = np.unique(vec.scramble(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                                 return_inverse=True, return_counts=True)
    return number, times


def measure(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Base counts, and for each text the normalised hash and word count of every line (0 words: no line)."""
    n = len(offsets) - 1
    starts, ends, first = vec.spans(buf, offsets, vec.NOT_SPACE)
    word = vec.NOT_SPACE[buf]
    out = {"n_words": np.diff(first), "word_chars": _sums(word & ((buf & 0xC0) != 0x80), offsets),
           "n_symbols": _sums(_SYMBOL[buf], offsets)}
    # 3-word windows of each text that occur twice or more in it
    exact = vec.hashes(buf, starts, ends, lower=False)
    at = vec.gram_starts(first, 3)
    text_of = vec.owners(first)
    number, times = _keyed(text_of[at], vec.grams(exact, 3)[at]) if len(at) else (at, at)
    twice = at[times[number] > 1] if len(at) else at
    out["n_repeat_words"] = _sums(vec.mark(len(starts), twice, twice + 3), first)
    # lines: exact bytes for repeats within the text, words for the normalised hash
    l_start, l_end, l_first = vec.spans(buf, offsets, _NO_LINE_END)
    a, b = np.searchsorted(starts, l_start), np.searchsorted(starts, l_end)
    l_words = b - a
    filled = l_words > 0
    l_text = vec.owners(l_first)
    l_hash = vec.hashes(buf, l_start, l_end, lower=False)
    out["n_dup_lines"] = np.zeros(n, np.int64)
    if filled.any():
        own = l_text[filled]
        number, times = _keyed(own, l_hash[filled])
        once = np.zeros(n, np.int64)
        _, some = np.unique(number, return_index=True)
        np.add.at(once, own[some], 1)
        out["n_dup_lines"] = np.bincount(own, minlength=n) - once
    low = vec.hashes(buf, starts, ends)
    base = np.uint64(0xD6E8FEB86659FD93)
    back = np.uint64(pow(int(base), -1, 1 << 64))
    chain = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * vec.powers(base, len(low)), out=chain[1:])
    normal = vec.scramble((chain[b] - chain[a]) * vec.powers(back, len(low) + 1)[a] + l_words.astype(np.uint64))
    cut = l_first[1:-1]
    text_hash = vec.hashes(buf, offsets[:-1], offsets[1:], lower=False)
    return out, np.split(normal, cut), np.split(np.where(filled, l_words, 0), cut), text_hash


def features(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Counts and line hashes of every row, written once; ``_row`` tells rows of one id apart."""
    schema = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host")).schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                counts, lines, sizes, whole = measure(buf, offsets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), vec.ints(whole), *[pa.array(counts[c].astype(np.int64)) for c in _COUNTS],
                    pa.array([x.view(np.int64) for x in lines], pa.list_(pa.int64())),
                    pa.array(sizes, pa.list_(pa.int32())),
                ], ["doc_id", "host", "text_hash", *_COUNTS, "lines", "sizes"])

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("_text")).mapInArrow(
        run, f"{kinds}, text_hash long, {', '.join(f'{c} long' for c in _COUNTS)}, lines array<long>, sizes array<int>")
    return materialize(out.withColumn("_row", F.monotonically_increasing_id()))


def frequent_lines(rows: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCS) -> DataFrame:
    """Host key and hash of the lines that more documents of the host have than its limit."""
    texts = rows.select("host", "text_hash", "lines").dropDuplicates(["host", "text_hash"])
    hosts = texts.groupBy("host").agg(F.count("*").alias("_docs"))
    seen = texts.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(
        F.count("*").alias("_n"))
    both = seen.where(F.col("_n") >= least).alias("s").join(hosts.alias("h"), F.col("s.host").eqNullSafe(F.col("h.host")))
    return both.where(F.col("_n") >= F.col("_docs") * share).select("s.host", "line")


def quality_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                   share: float = LINE_SHARE, least: int = LINE_DOCS, left_share: float = LEFT_SHARE) -> DataFrame:
    """One row per document: base counts, verdicts, words left, and the numbers of the lines to remove."""
    rows = features(docs, doc_id, text, host)
    often = frequent_lines(rows, share, least)
    lines = rows.select("_row", "host", F.posexplode(F.arrays_zip("lines", "sizes")).alias("_at", "_line")).select(
        "_row", "_at", F.xxhash64("host", "_line.lines").alias("_key"), "_line.sizes").where("sizes > 0")
    gone = lines.join(often.select(F.xxhash64("host", "line").alias("_key")), "_key").groupBy("_row").agg(
        F.sum("sizes").alias("_words"), F.sort_array(F.collect_list("_at")).alias("drop_lines"))
    out = rows.drop("lines", "sizes", "text_hash").join(gone, "_row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("_words", F.lit(0))
    return out.select(
        "doc_id", *_COUNTS, failed.alias("base_failed"), left.alias("n_words_left"),
        (~failed & (left >= left_share * F.col("n_words"))).alias("kept"),
        F.coalesce("drop_lines", F.array().cast("array<int>")).alias("drop_lines"))


def remove_lines(docs: DataFrame, report: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Kept documents with their frequent lines removed; ids must be unique.

    Line numbers count lines that have a character, as the report does.
    """
    plan = report.where("kept").select(F.col("doc_id").alias("_id"), F.col("drop_lines").alias("_drop"))
    joined = docs.join(plan, F.col(doc_id) == F.col("_id"))
    filled = F.filter(F.split(F.col(text), "\n", -1), lambda x: F.length(x) > 0)
    left = F.array_join(F.filter(filled, lambda x, i: ~F.array_contains("_drop", i)), "\n")
    return joined.select(*[F.when(F.size("_drop") > 0, left).otherwise(F.col(text)).alias(c) if c == text else F.col(c)
                           for c in docs.columns])
