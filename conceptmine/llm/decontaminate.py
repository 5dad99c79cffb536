"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items make one automaton. Document words are streamed through it;
at every word it knows the longest run of words ending there that some item has. A
run as long as the window, or a whole item that is shorter than the window, is a hit.
Most text is nowhere near an item: the stream starts only where enough item n-grams
follow each other, which leaves out no window.

A benchmark that is too large to broadcast is dealt to parts by its texts. Each part is looked for
in all documents on its own; then the hit spans and items of a text are united over
the parts and judged once.

Defined results: a null or empty text has no words, is not contaminated and stays as
it is; equal items count once per item id, a null item id is written as an empty
text; an empty benchmark hits nothing; further columns are carried and never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptmine.llm import vec
from conceptmine.llm.keyset import key_set
from conceptmine.llm.rows import free_name
from conceptmine.operators.skew import salted_join
from conceptmine.session import materialize

WINDOW = 13
#: A document is contaminated from this share of hit words on (one of twenty).
SHARE = 20
#: Bytes of item texts and ids that are broadcast at once, about; a larger benchmark is taken in parts.
PART_BYTES = 8 << 20
GRAM = 6

REPORT = ("n_words long, n_hit long, longest long, n_items long, items_sha256 string, contaminated boolean")


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: Items whose window of full length is the state's; short items that end in the state.
        self.windows: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.windows.setdefault(self._cut(state, window), set()).add(item)
            if 0 < len(words) < window:
                short.setdefault(self._cut(state, len(words)), []).append((len(words), item))
        #: For every state the short items on its chain of links.
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[state] = short.get(state, []) + self.short[self.link[state]] if short else []

    def _cut(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of what has led to ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _copy(self, state: int, word: int, target: int) -> int:
        twin = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = twin
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:  # an earlier item has this run already
            return target if self.length[target] == self.length[last] + 1 else self._copy(last, word, target)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._copy(state, word, target)
        return new

    def stream(self, words: list[int], hit: np.ndarray, found: set[str]) -> int:
        """Mark hit words and add found items; returns the longest match."""
        state = matched = longest = 0
        window, nexts, link, length = self.window, self.next, self.link, self.length
        for i, w in enumerate(words):
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w in nexts[state]:
                state, matched = nexts[state][w], matched + 1
            else:
                matched = 0
            longest = max(longest, matched)
            if matched >= window:
                hit[i + 1 - window:i + 1] = True
                found |= self.windows[self._cut(state, window)]
            for n, item in self.short[state]:
                if n <= matched:
                    hit[i + 1 - n:i + 1] = True
                    found.add(item)
        return longest


class Matcher:
    """What every task needs: the automaton, word numbers, and the n-grams that open a stream."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in items], pa.string())})
        runs: list[np.ndarray] = []
        for _, buf, offsets in vec.slices(texts, "text"):
            starts, ends, first = vec.spans(buf, offsets, vec.LETTERS)
            h = vec.hashes(buf, starts, ends)
            runs += [h[a:b] for a, b in zip(first[:-1], first[1:])]
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *runs]))
        numbered = [(item, np.searchsorted(self.vocabulary, h).tolist()) for (item, _), h in zip(items, runs)]
        self.automaton = Automaton([(i, w) for i, w in numbered if w], window)
        sizes = [min(window, len(h)) for h in runs if len(h)]
        self.gram = min([GRAM, *sizes])
        #: Item n-grams in a row that any window has.
        self.in_a_row = min([window, *sizes]) - self.gram + 1
        self.grams = np.unique(np.concatenate([np.empty(0, np.uint64), *[vec.grams(h, self.gram) for h in runs]]))
        self.mask = np.uint64(max(1 << 16, 1 << int(16 * len(self.grams)).bit_length()) - 1)
        self.seen = np.zeros(int(self.mask) + 1, bool)
        self.seen[(self.grams & self.mask).astype(np.int64)] = True

    def regions(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words, each within one text, that hold every window there is."""
        at = vec.gram_starts(first, self.gram)
        none = np.empty(0, np.int64)
        if not len(at) or not len(self.grams):
            return none, none
        g = vec.grams(words, self.gram)[at]
        maybe = np.flatnonzero(self.seen[(g & self.mask).astype(np.int64)])
        maybe = maybe[self.grams[np.minimum(np.searchsorted(self.grams, g[maybe]), len(self.grams) - 1)] == g[maybe]]
        at = at[maybe]
        if not len(at):
            return none, none
        text = np.searchsorted(first, at, "right")
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(text) != 0)) + 1
        begin, end = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
        long = end - begin + 1 >= self.in_a_row
        return begin[long], end[long] + self.gram

    def match(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]], dict[int, int]]:
        """Hit words, and by text the items found and the longest match."""
        hit = np.zeros(len(words), bool)
        found: dict[int, set[str]] = {}
        longest: dict[int, int] = {}
        for a, b in zip(*self.regions(words, first)):
            text = int(np.searchsorted(first, a, "right")) - 1
            n = self.automaton.stream(np.searchsorted(self.vocabulary, words[a:b]).tolist(), hit[a:b],
                                      found.setdefault(text, set()))
            longest[text] = max(longest.get(text, 0), n)
        return hit, found, longest


class Items:
    """The items of a benchmark that have words, in parts that can be broadcast one after the other."""

    def __init__(self, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES):
        self.window = window
        rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
        # a word has a letter, a digit or a character beyond ASCII
        rows = rows.where(F.regexp_like("text", F.lit(r"[0-9A-Za-z]|[^\x00-\x7F]"))).distinct()
        size = rows.agg(F.sum(F.octet_length("item") + F.octet_length("text"))).first()[0] or 0
        self.parts = 1 if size <= part_bytes else -(-2 * size // part_bytes)
        part = F.pmod(F.xxhash64("text"), F.lit(self.parts)).alias("part")
        self.rows = rows.withColumn("part", part) if self.parts == 1 else materialize(rows.withColumn("part", part))

    def matcher(self, part: int) -> Matcher:
        """The automaton of a part; equal texts are in one, so it is about as large as the bound says, or one text."""
        rows = self.rows.where(F.col("part") == part).select("item", "text")
        return Matcher(sorted(map(tuple, rows.collect())), self.window)


def _key(text: str) -> Column:
    """128 bits to know a text by."""
    return F.struct(F.xxhash64(F.col(f"`{text}`")).alias("a"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("b"))


_HITS = "n_words long, longest long, begins array<long>, ends array<long>, items array<string>"


def united_hits(docs: DataFrame, items: Items, text: str) -> DataFrame:
    """``key``, ``n_words``, ``n_hit``, ``longest``, ``begins``, ``ends`` and ``items`` of every text that any part hits."""
    texts = docs.select(_key(text).alias("key"), F.col(text).alias("_text"))

    def looked_up(shared) -> DataFrame:
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, buf, offsets in vec.slices(batch, "_text"):
                    starts, ends, first = vec.spans(buf, offsets, vec.LETTERS)
                    hit, found, longest = shared.value.match(vec.hashes(buf, starts, ends), first)
                    have, out = [t for t in sorted(found) if found[t]], []
                    for t in have:
                        edge = np.diff(np.r_[0, hit[first[t]:first[t + 1]].astype(np.int8), 0])
                        out.append((int(first[t + 1] - first[t]), longest[t], np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), sorted(found[t])))
                    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(have, pa.int64())), *[pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]],
                        ["key", "n_words", "longest", "begins", "ends", "items"])

        found = texts.mapInArrow(look, f"key struct<a: long, b: long>, {_HITS}")
        # copies of a text have the same hits
        return materialize(found.groupBy("key").agg(*[F.first(c).alias(c) for c in found.columns[1:]]))

    parts = [looked_up(docs.sparkSession.sparkContext.broadcast(items.matcher(i))) for i in range(items.parts)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    columns = ["begins", "ends", "items"]
    # one row of a text for each part
    every = every.groupBy("key").agg(F.first("n_words").alias("n_words"), F.max("longest").alias("longest"),
                                     *[F.flatten(F.collect_list(c)).alias(c) for c in columns])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, begins, ends, items = (batch.column(c).to_pylist() for c in ("n_words", *columns))
            spans = []
            for n, b, e in zip(n_words, begins, ends):
                edge = np.diff(np.r_[0, vec.mark(n, np.array(b, np.int64), np.array(e, np.int64)).astype(np.int8), 0])
                spans.append((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("n_words"), pa.array([int((e - b).sum()) for b, e in spans], pa.int64()),
                batch.column("longest"), pa.array([b for b, _ in spans], lists), pa.array([e for _, e in spans], lists),
                pa.array([sorted(set(i)) for i in items], pa.list_(pa.string()))],
                ["key", "n_words", "n_hit", "longest", *columns])

    return materialize(every.mapInArrow(unite, f"key struct<a: long, b: long>, n_words long, n_hit long, {_HITS.split(', ', 1)[1]}"))


def _verdict(n_hit, n_words):
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: words, hit words, longest match, items found, and the verdict."""
    items = Items(benchmark, window=window, part_bytes=part_bytes)
    kind = docs.schema[doc_id].dataType.simpleString()
    if items.parts > 1:
        return _contamination_by_parts(docs, items, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(items.matcher(0))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                starts, ends, first = vec.spans(buf, offsets, vec.LETTERS)
                hit, found, longest = m.match(vec.hashes(buf, starts, ends), first)
                sums = np.r_[0, np.cumsum(hit)]
                n_words, n_hit = np.diff(first), sums[first[1:]] - sums[first[:-1]]
                names = [",".join(sorted(found.get(i, ()))) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n_words), pa.array(n_hit),
                    pa.array([longest.get(i, 0) for i in range(part.num_rows)], pa.int64()),
                    pa.array([len(found.get(i, ())) for i in range(part.num_rows)], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names], pa.string()),
                    pa.array(_verdict(n_hit, n_words)),
                ], [doc_id, "n_words", "n_hit", "longest", "n_items", "items_sha256", "contaminated"])

    return docs.select(doc_id, F.col(text).alias("_text")).mapInArrow(report, f"`{doc_id}` {kind}, {REPORT}")


def _contamination_by_parts(docs: DataFrame, items: Items, doc_id: str, text: str) -> DataFrame:
    hits = united_hits(docs, items, text).select(
        "key", "n_hit", "longest", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    rows = docs.select(F.col(doc_id).alias("_id"), _key(text).alias("key"), F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                _, _, first = vec.spans(buf, offsets, vec.LETTERS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first))], ["_id", "key", "n_words"])

    kind = rows.schema["_id"].dataType.simpleString()
    counted = materialize(rows.mapInArrow(count, f"_id {kind}, key struct<a: long, b: long>, n_words long"))
    n_hit, n_words = F.coalesce("n_hit", F.lit(0)), F.col("n_words")
    return salted_join(counted, hits, "key", "left").select(
        F.col("_id").alias(doc_id), "n_words", n_hit.alias("n_hit"), F.coalesce("longest", F.lit(0)).alias("longest"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(hashlib.sha256().hexdigest())).alias("items_sha256"),
        _verdict(n_hit, n_words).alias("contaminated"))


def cut_words(buf: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
              drop: np.ndarray, texts: np.ndarray) -> dict[int, str | None]:
    """New texts, by place, of the given texts without their dropped words; None if no word is left.

    What stands between dropped words goes with them; the rest of the text stays as it is.
    """
    out: dict[int, str | None] = {}
    for t in texts.tolist():
        a, b = int(first[t]), int(first[t + 1])
        gone = drop[a:b]
        if gone.all():
            out[t] = None
            continue
        edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
        pieces, at = [], int(offsets[t])
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            pieces.append(buf[at:starts[a + s]].tobytes())
            at = int(ends[a + e - 1])
        pieces.append(buf[at:offsets[t + 1]].tobytes())
        out[t] = b"".join(pieces).decode()
    return out


def replace_texts(part: pa.RecordBatch, text: str, n_chars: str | None, new: dict[int, str | None]) -> pa.RecordBatch:
    """The batch with new texts and lengths; rows whose new text is None go."""
    if not new:
        return part
    at = part.schema.get_field_index(text)
    texts = part.column(at).to_pylist()
    for i, t in new.items():
        texts[i] = t
    columns = list(part.columns)
    columns[at] = pa.array(texts, part.schema.field(at).type)
    if n_chars is not None:
        k = part.schema.get_field_index(n_chars)
        counts = part.column(k).to_pylist()
        for i, t in new.items():
            counts[i] = len(t) if t is not None else 0
        columns[k] = pa.array(counts, part.schema.field(k).type)
    keep = np.ones(part.num_rows, bool)
    keep[[i for i, t in new.items() if t is None]] = False
    return pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = None,
                  window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents without their hit spans where these reach the limit of coverage; other documents are untouched.

    A document of which no word is left goes. ``n_chars`` names a column of text lengths to keep up.
    """
    items = Items(benchmark, window=window, part_bytes=part_bytes)
    if items.parts > 1:
        return _decontaminate_by_parts(docs, items, text, n_chars)
    shared = docs.sparkSession.sparkContext.broadcast(items.matcher(0))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, text):
                starts, ends, first = vec.spans(buf, offsets, vec.LETTERS)
                hit, _, _ = m.match(vec.hashes(buf, starts, ends), first)
                sums = np.r_[0, np.cumsum(hit)]
                n_words, n_hit = np.diff(first), sums[first[1:]] - sums[first[:-1]]
                bad = np.flatnonzero(_verdict(n_hit, n_words))
                yield replace_texts(part, text, n_chars, cut_words(buf, offsets, starts, ends, first, hit, bad))

    return docs.mapInArrow(clean, docs.schema)


def _decontaminate_by_parts(docs: DataFrame, items: Items, text: str, n_chars: str | None) -> DataFrame:
    """Only texts that may be contaminated are moved to meet their spans."""
    bad = materialize(united_hits(docs, items, text).where(_verdict(F.col("n_hit"), F.col("n_words"))).select("key", "begins", "ends"))
    some = docs.sparkSession.sparkContext.broadcast(key_set(bad.select(F.col("key.a").alias("a")), "a"))
    quoted = [f"`{c}`" for c in docs.columns]
    key, begins, ends_ = (free_name(docs, n) for n in ("_key", "_begins", "_ends"))
    keyed = docs.withColumn(key, _key(text))

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = batch.column(batch.num_columns - 1).flatten()[0].to_numpy()
                yield batch.filter(pa.array(some.value.maybe(first) == wanted))
        return run

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, text):
                starts, ends, first = vec.spans(buf, offsets, vec.LETTERS)
                spans = list(zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()))
                have = np.array([i for i, (b, _) in enumerate(spans) if b], np.int64)
                at = [np.array([first[i] + x for i in have for x in spans[i][k]], np.int64) for k in (0, 1)]
                gone = vec.mark(len(starts), *at) if len(have) else np.zeros(len(starts), bool)
                new = cut_words(buf, offsets, starts, ends, first, gone, have)
                yield replace_texts(part, text, n_chars, new).select(docs_columns)

    docs_columns = docs.columns
    plain = keyed.mapInArrow(side(False), keyed.schema).select(*quoted)
    maybe = keyed.mapInArrow(side(True), keyed.schema).alias("d").join(bad.alias("f"), F.col(f"d.`{key}`") == F.col("f.key"), "left")
    maybe = maybe.select(*[F.col(f"d.{c}") for c in quoted], F.col("f.begins").alias(begins), F.col("f.ends").alias(ends_))
    return plain.union(maybe.mapInArrow(cut, docs.schema))
