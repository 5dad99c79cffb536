"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Only the number of
documents per pattern of votes is gathered (over all documents; there are at most 3^9
patterns); expectation-maximisation on these counts estimates how accurate each heuristic
is for good and for bad text, and gives each pattern a posterior. The posteriors of a
bounded sample train a linear scorer on hashed word shapes, which scores every document.

Defined results: a null or empty text has no votes and no features and is not kept; rows
with equal ids are scored one by one; without documents nothing is fitted and no rows are
returned; further columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.llm import vec
from conceptmine.session import materialize

#: Documents that the scorer is fitted on, at most; those with the smallest hashes of their texts.
FIT_ROWS = 6_000
#: Weights of the scorer.
BUCKETS = 1 << 16
KEEP = 0.5
BAD, NONE, GOOD = 0, 1, 2

#: Heuristics: name, kind of fault, bad from (above), good up to; texts in between get no vote.
HEURISTICS = [
    ("capitals", "shouting", 0.30, 0.10), ("exclamations", "shouting", 0.30, 0.05), ("signs", "signs", 0.20, 0.02),
    ("odd_ends", "signs", 0.20, 0.05), ("bars", "tables", 0.10, 0.01), ("lone_signs", "tables", 0.15, 0.05),
    ("repeated_words", "repetition", 0.60, 0.45), ("repeated_runs", "repetition", 0.30, 0.10),
    ("same_as_before", "repetition", 0.10, 0.03),
]
KINDS = sorted({kind for _, kind, _, _ in HEURISTICS})
#: Below this many words the shares of repeated words say nothing.
FEW_WORDS = 20

# Classes of bytes for word shapes: runs of one class become one byte.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[128:] = _SHAPE[ord("a"):ord("z") + 1] = ord("a")
_SHAPE[ord("A"):ord("Z") + 1] = ord("A")
_SHAPE[ord("0"):ord("9") + 1] = ord("0")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _SIGNS, _BANG, _BAR = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("#*$%&<>"), _table("!"), _table("|")
#: Last bytes of words that are neither letter, digit nor a usual sign there.
_ODD = (~vec.LETTERS).astype(np.int64)
_ODD[[ord(c) for c in ".,;:?!)\"']}-"]] = 0


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _repeats(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many values of each text are equal to another one of it before them."""
    if not len(h):
        return np.zeros(n)
    _, some = np.unique(vec.scramble(h + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return (np.bincount(owner, minlength=n) - np.bincount(owner[some], minlength=n)).astype(np.float64)


def votes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words, one column of votes per heuristic, and the shares behind them."""
    n = len(offsets) - 1
    starts, ends, first = vec.spans(buf, offsets, vec.NOT_SPACE)
    words = np.diff(first).astype(np.float64)
    some = np.maximum(words, 1)
    letters = np.maximum(_sums(vec.LETTERS[buf], offsets), 1)
    text = vec.owners(first)
    h = vec.hashes(buf, starts, ends)
    at = vec.gram_starts(first, 3)
    runs = _repeats(text[at], vec.grams(h, 3)[at], n) if len(at) else np.zeros(n)
    after = np.r_[False, h[1:] == h[:-1]][:len(h)] & np.r_[False, text[1:] == text[:-1]][:len(h)]
    inside = np.r_[0, np.cumsum(vec.LETTERS[buf])]
    share = np.stack([
        _sums(_UPPER[buf], offsets) / letters, _sums(_BANG[buf], offsets) / some, _sums(_SIGNS[buf], offsets) / some,
        np.bincount(text, _ODD[buf[ends - 1]], n) / some, _sums(_BAR[buf], offsets) / some,
        np.bincount(text, inside[ends] == inside[starts], n) / some,
        _repeats(text, h, n) / some, runs / some, np.bincount(text, after, n) / some], axis=1)
    out = np.full(share.shape, NONE, np.int8)
    for j, (_, _, bad, good) in enumerate(HEURISTICS):
        out[share[:, j] >= bad, j] = BAD
        out[share[:, j] <= good, j] = GOOD
    few = words < FEW_WORDS
    out[few, 6:9] = NONE
    out[words == 0] = NONE
    return words, out, share


def shapes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash bucket of the shape of every word, and of each share in steps."""
    shape = _SHAPE[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = shape[1:] != shape[:-1]
    cuts = offsets[1:-1]
    keep[cuts[cuts < len(buf)]] = True
    place = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    short, bounds = shape[keep], place[offsets]
    starts, ends, first = vec.spans(short, bounds, vec.NOT_SPACE)
    h = vec.hashes(short, starts, ends, lower=False)
    return vec.owners(first), (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def inputs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of the scorer: text, bucket, value. Shares of word shapes, and steps of the heuristics' shares."""
    n = len(offsets) - 1
    owner, bucket = shapes(buf, offsets)
    key, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    owner, bucket = key // BUCKETS, key % BUCKETS
    words, _, share = votes(buf, offsets)
    value = count / np.maximum(words, 1)[owner]
    step = np.minimum((share * 10).astype(np.int64), 20) + 21 * np.arange(share.shape[1])
    filled = np.flatnonzero(words > 0)
    more = (vec.scramble(step[filled].astype(np.uint64) + np.uint64(1 << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    return (np.r_[owner, np.repeat(filled, share.shape[1])], np.r_[bucket, more.ravel()], np.r_[value, np.full(more.size, 0.5)])


class LabelModel:
    """Chances of a vote for and against, by heuristic, for good text and each kind of bad text; and their shares.

    Bad text comes in kinds that different heuristics see, so their votes are independent within
    a kind, not within all bad text.
    """

    def __init__(self, pattern: np.ndarray, count: np.ndarray, kinds: np.ndarray | None = None, rounds: int = 200):
        kinds = np.array([KINDS.index(k) for _, k, _, _ in HEURISTICS]) if kinds is None else kinds
        vote = np.eye(3)[pattern]  # pattern, heuristic, vote
        # start: the last class is good; a vote against a text counts for the heuristic's kind
        against = np.stack([((pattern == BAD) & (kinds == k)).sum(axis=1) for k in range(kinds.max() + 1)]).astype(float)
        some = against.sum(axis=0)
        chance = np.concatenate([against / np.maximum(some, 1) * 0.8 + 0.002, [np.where(some > 0, 0.2, 1.0)]])
        chance /= chance.sum(axis=0)
        for _ in range(rounds):
            weight = chance * count
            self.share = (weight.sum(axis=1) + 0.1) / (count.sum() + 0.1 * len(chance))
            self.chance = np.einsum("cp,pjv->cjv", weight, vote)
            self.chance[:, :, NONE] = 0
            self.chance[:, :, [BAD, GOOD]] += 0.1
            self.chance /= self.chance.sum(axis=2, keepdims=True)
            self.chance[:, :, NONE] = 1  # no vote says nothing
            new = self.classes(pattern)
            if np.abs(new - chance).max() < 1e-9:
                break
            chance = new

    def classes(self, pattern: np.ndarray) -> np.ndarray:
        """Chance of each class for each row of votes."""
        j = np.arange(pattern.shape[1])
        log = np.log(self.chance[:, j, pattern]).sum(axis=2) + np.log(self.share)[:, None]
        out = np.exp(log - log.max(axis=0))
        return out / out.sum(axis=0)

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Chance that texts with these votes are good."""
        return self.classes(pattern)[-1]


def fit_linear(owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray, steps: int = 400,
               rate: float = 0.2, ridge: float = 1e-6) -> np.ndarray:
    """Logistic weights of soft labels, by Adam over all rows; the last one is the constant."""
    x, m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, steps + 1):
        score = np.bincount(owner, x[bucket] * value, len(target)) + x[-1]
        error = (target - 1 / (1 + np.exp(-np.clip(score, -40, 40)))) / len(target)
        g = np.r_[np.bincount(bucket, error[owner] * value, BUCKETS), error.sum()] - ridge * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return x


class Quality:
    """The label model and the scorer's weights."""

    def __init__(self, labels: LabelModel | None, weight: np.ndarray):
        self.labels, self.weight = labels, weight

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        owner, bucket, value = inputs(buf, offsets)
        z = np.bincount(owner, self.weight[bucket] * value, len(offsets) - 1) + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


_POWERS = 3 ** np.arange(len(HEURISTICS))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Quality:
    """Label model from the votes on all different texts, scorer from a bounded sample of their posteriors.

    The sample has at most ``rows`` texts, those with the smallest hashes.
    """
    # copies say nothing new about a heuristic or a word: every text counts once
    texts = docs.where(F.length(text) > 0).select(F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                words, v, _ = votes(buf, offsets)
                some = pa.array(words > 0)
                kind = pa.array((v * _POWERS).sum(axis=1).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(some), kind.filter(some)], ["hash", "pattern"])

    cast = materialize(texts.mapInArrow(vote, "hash long, pattern int").distinct())
    found = cast.groupBy("pattern").agg(F.count("*").alias("n")).toArrow()
    if not found.num_rows:
        return Quality(None, np.zeros(BUCKETS + 1))
    order = np.argsort(found.column("pattern").to_numpy())
    code, count = found.column("pattern").to_numpy()[order], found.column("n").to_numpy()[order].astype(np.float64)
    labels = LabelModel(code[:, None] // _POWERS % 3, count)
    shared = docs.sparkSession.sparkContext.broadcast(labels)
    # the sample: the texts with the smallest hashes, read again whole, one row for each
    cut = cast.select("hash").orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]
    sample = texts.where(F.col("_hash") <= F.lit(cut)).dropDuplicates(["_hash"]).select("_text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                _, v, _ = votes(buf, offsets)
                owner, bucket, value = inputs(buf, offsets)
                order = np.argsort(owner, kind="stable")
                bounds = np.searchsorted(owner[order], np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(shared.value.posterior(v)), pa.ListArray.from_arrays(bounds, pa.array(bucket[order].astype(np.int32))),
                    pa.ListArray.from_arrays(bounds, pa.array(value[order]))], ["target", "bucket", "value"])

    got = sample.mapInArrow(sparse, "target double, bucket array<int>, value array<double>").toArrow()  # at most `rows` rows
    if not got.num_rows:
        return Quality(labels, np.zeros(BUCKETS + 1))
    lists = got.column("bucket").combine_chunks()
    owner = np.repeat(np.arange(got.num_rows), lists.value_lengths().to_numpy())
    weight = fit_linear(owner, lists.flatten().to_numpy().astype(np.int64), got.column("value").combine_chunks().flatten().to_numpy(),
                        got.column("target").combine_chunks().to_numpy())
    return Quality(labels, weight)


def score(docs: DataFrame, model: Quality, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``posterior`` of the votes, ``score`` of the linear scorer, and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                words, v, _ = votes(buf, offsets)
                labels = shared.value.labels
                posterior = labels.posterior(v) if labels else np.full(part.num_rows, 0.5)
                s = shared.value.scores(buf, offsets)
                empty = words == 0
                posterior[empty], s[empty] = 0.0, 0.0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(posterior), pa.array(s), pa.array((s >= KEEP) & ~empty)],
                    ["doc_id", "posterior", "score", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, posterior double, score double, kept boolean")
