"""Repeated passages by a sparse suffix array.

Of each window of ``min_words`` words only the suffix at its content-selected minimiser
is retained: the least hash of a few words near the window's begin. Equal windows pick
the same place, so every repeated passage meets at a retained suffix whose next words
(``right`` of them) are equal. The retained suffixes are sorted by those words, then by
document and place, in range partitions that split any run of equal ones. Each suffix is
compared with the first of its run and the match is extended to the left and right, to
the windows that the minimiser stands for:

* a window that the first suffix of the run has too is a repeat of an earlier one;
* the others can only repeat each other; they, and the first suffixes of runs that a
  partition's edge may cut, are compared once more by their whole content.

So the result is exact: a word is removed if and only if it lies in a window of
``min_words`` words that occurs at an earlier place, by document id and position.

Defined results: words are split at ASCII white space and lower-cased (A-Z); a null or
short text has no window and stays; rows with equal id and text count as one document; a
null id comes before all others; a document of which no word is left goes; an empty
table gives no rows; further columns are carried and never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.llm import vec
from conceptmine.llm.decontaminate import cut_words, replace_texts
from conceptmine.llm.keyset import key_set
from conceptmine.llm.rows import free_name, may_be_in, written
from conceptmine.session import materialize

MIN_WORDS = 51
#: Words of the hash that selects a minimiser, and places among which it is the least.
GRAM, PLACES = 8, 17
#: Retained suffixes that a range partition is meant to hold.
PARTITION_ROWS = 200_000


def retained(buf: np.ndarray, offsets: np.ndarray, min_words: int, places: int) -> tuple[np.ndarray, ...]:
    """Text, word place, key, first window and number of windows of each retained suffix; all window hashes."""
    starts, ends, first = vec.spans(buf, offsets, vec.NOT_SPACE)
    window = vec.gram_starts(first, min_words)
    none = np.empty(0, np.int64)
    if not len(window):
        return none, none, none.view(np.uint64), none, none, none.view(np.uint64)
    words = vec.hashes(buf, starts, ends)
    gram = min(GRAM, min_words - places + 1)
    best = (vec.grams(words, gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(words) - gram + 1, dtype=np.uint64)
    size = 1
    while 2 * size <= places:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < places:
        best = np.minimum(best[:size - places or None], best[places - size:])
    at = (best[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(first, window, "right") - 1
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(window)])
    key = vec.grams(words, min_words - places + 1)[at[begin]]
    own = text[begin]
    return own, at[begin] - first[own], key, window[begin] - first[own], count, vec.grams(words, min_words)[window]


def _suffixes(docs: DataFrame, min_words: int, places: int, some=None) -> DataFrame:
    """Keys of all retained suffixes; or, given a key set, the suffixes whose key may be in it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                own, place, key, window, count, h = retained(buf, offsets, min_words, places)
                if some is None:
                    yield pa.RecordBatch.from_arrays([vec.ints(key)], ["key"])
                    continue
                keep = some.value.maybe(key)
                h = h[np.repeat(keep, count)].view(np.int64)
                own, place, key, window, count = (x[keep] for x in (own, place, key, window, count))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(h))
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([
                    vec.ints(key), part.column(0).take(take), part.column(1).take(take), pa.array(place), pa.array(window), lists],
                    ["key", "doc_id", "text_hash", "place", "window", "hashes"])

    schema = "key long" if some is None else (
        f"key long, doc_id {kind}, text_hash long, place long, window long, hashes array<long>")
    return docs.mapInArrow(run, schema)


def _compare(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes against the first of their run: repeated spans, and windows for the second comparison."""
    names = ["doc_id", "text_hash", "begin", "end", "first_doc", "first_begin", "hash"]

    def windows_of(row: pa.RecordBatch) -> pa.RecordBatch:
        h = row.column(5).flatten()
        n = len(h)
        begin = pa.array(row.column(4).to_numpy()[0] + np.arange(n))
        zero = pa.array(np.zeros(n, np.int64))
        return pa.RecordBatch.from_arrays([
            row.column(1).take(zero), row.column(2).take(zero), begin, pa.array(begin.to_numpy() + min_words),
            pa.nulls(n, row.column(1).type), pa.nulls(n, pa.int64()), h], names)

    lead: pa.RecordBatch | None = None  # first suffix of the run that is open
    for batch in batches:
        if not batch.num_rows:
            continue
        carried = lead is not None
        if carried:
            batch = pa.Table.from_batches([lead, batch]).combine_chunks().to_batches()[0]
        else:
            yield windows_of(batch.slice(0, 1))
        key, place, window = (batch.column(i).to_numpy() for i in (0, 3, 4))
        text_hash, doc = batch.column(2).to_numpy(), batch.column(1)
        lists = batch.column(5)
        count = lists.value_lengths().to_numpy().astype(np.int64)
        flat = lists.flatten().to_numpy()
        start = np.cumsum(count) - count
        n = batch.num_rows
        leader = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(n), 0))
        row = np.repeat(np.arange(n), count)
        at = np.arange(len(flat)) - start[row]
        depth = place[row] - window[row] - at  # words from the window's begin to the minimiser
        to = leader[row]
        other = place[to] - window[to] - depth
        fits = (other >= 0) & (other < count[to])
        equal = fits & (flat[np.where(fits, start[to] + other, 0)] == flat)
        # repeated input rows are the same place, not a repeat
        same = (place == place[leader]) & (text_hash == text_hash[leader])
        if same.any():
            ids = doc.to_pylist()
            same &= np.fromiter((ids[i] == ids[j] for i, j in enumerate(leader.tolist())), bool, n)
        live = ~same[row]
        hit = np.flatnonzero(equal & live)
        if len(hit):
            cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(row[hit]) != 0)) + 1
            a, b = hit[np.r_[0, cut]], hit[np.r_[cut - 1, len(hit) - 1]]
            r, f = row[a], to[a]
            yield pa.RecordBatch.from_arrays([
                doc.take(pa.array(r)), pa.array(text_hash[r]), pa.array(window[r] + at[a]),
                pa.array(window[r] + at[b] + min_words), doc.take(pa.array(f)), pa.array(window[f] + other[a]),
                pa.nulls(len(a), pa.int64())], names)
        rest = np.flatnonzero(~equal & live)
        if len(rest):
            r = row[rest]
            begin = window[r] + at[rest]
            yield pa.RecordBatch.from_arrays([
                doc.take(pa.array(r)), pa.array(text_hash[r]), pa.array(begin), pa.array(begin + min_words),
                pa.nulls(len(r), doc.type), pa.nulls(len(r), pa.int64()), pa.array(flat[rest])], names)
        lead = batch.slice(int(leader[-1]), 1)
        vec.give_back()
    if lead is not None:
        yield windows_of(lead)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping spans of a document as one, with the smallest source."""
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            own: list[list] = []
            for s in sorted(spans, key=lambda s: (s["begin"], s["end"])):
                if own and s["begin"] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], s["end"])
                    if s["first_doc"] is None or own[-1][2] is not None and s["first_doc"] < own[-1][2]:
                        own[-1][2] = s["first_doc"]
                else:
                    own.append([s["begin"], s["end"], s["first_doc"]])
            out.append([{"begin": b, "end": e, "first_doc": f} for b, e, f in own])
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("first_doc", batch.column(0).type)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["doc_id", "text_hash", "spans"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with words to remove: ``doc_id``, ``text_hash`` and their ``spans`` of words (begin, end, first_doc).

    ``first_doc`` is an earlier document, or the same one, that has the words too.
    """
    if min_words < 2:
        raise ValueError("a passage has at least two words")
    places = min(PLACES, (min_words + 1) // 2)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    keys = _suffixes(rows, min_words, places).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", "n")
    keys = written(keys)
    some = docs.sparkSession.sparkContext.broadcast(key_set(keys, "key"))
    parts = int(-(-(keys.agg(F.sum("n")).first()[0] or 0) // PARTITION_ROWS))
    parts = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "doc_id", "text_hash", "place"]
    suffixes = written(_suffixes(rows, min_words, places, some))
    compared = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        lambda b: _compare(b, min_words),
        f"doc_id {kind}, text_hash long, begin long, end long, first_doc {kind}, first_begin long, hash long")
    compared = materialize(compared)
    open_ = compared.where("hash IS NOT NULL").select("hash", "doc_id", "text_hash", "begin", "end")
    place = F.struct("doc_id", "text_hash", "begin")
    least = open_.groupBy("hash").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("hash", "f")
    again = open_.join(least, "hash").where(~place.eqNullSafe(F.col("f")))
    spans = compared.where("hash IS NULL").select("doc_id", "text_hash", "begin", "end", "first_doc").union(
        again.select("doc_id", "text_hash", "begin", "end", "f.doc_id"))
    by_doc = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end", "first_doc")).alias("spans"))
    return materialize(by_doc.mapInArrow(
        _merged, f"doc_id {kind}, text_hash long, spans array<struct<begin: long, end: long, first_doc: {kind}>>"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = None,
                   min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the words that repeat an earlier passage; only texts that change are shuffled."""
    found = repeated_spans(docs, doc_id, text, min_words)
    some = docs.sparkSession.sparkContext.broadcast(key_set(found, "text_hash"))
    columns, quoted = docs.columns, [f"`{c}`" for c in docs.columns]
    text_hash, own_spans, concerned = (free_name(docs, c) for c in ("_text_hash", "_own_spans", "_concerned"))
    hashed = docs.withColumn(text_hash, F.xxhash64(F.col(f"`{text}`"))).withColumn(concerned, may_be_in(some)(text_hash))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, text):
                spans = part.column(part.num_columns - 1).to_pylist()
                starts, ends, first = vec.spans(buf, offsets, vec.NOT_SPACE)
                have = [i for i, s in enumerate(spans) if s]
                a = np.array([first[i] + s["begin"] for i in have for s in spans[i]], np.int64)
                b = np.array([first[i] + s["end"] for i in have for s in spans[i]], np.int64)
                gone = vec.mark(len(starts), a, b) if len(a) else np.zeros(len(starts), bool)
                new = cut_words(buf, offsets, starts, ends, first, gone, np.array(have, np.int64))
                yield replace_texts(part, text, n_chars, new).select(columns)

    plain = hashed.where(~F.col(concerned)).select(*quoted)
    touched = hashed.where(F.col(concerned)).alias("d").join(
        found.alias("f"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("f.doc_id")) & (F.col(f"d.`{text_hash}`") == F.col("f.text_hash")), "left")
    touched = touched.select(*[F.col(f"d.{c}") for c in quoted], F.col("f.spans").alias(own_spans))
    # written first, so that no task holds two workers
    return plain.union(written(touched).mapInArrow(cut, docs.schema))
