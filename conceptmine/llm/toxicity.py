"""Severity of toxic text by cumulative-link ordinal regression.

P(grade <= k) = logistic(threshold_k - w.x) with rising thresholds and one weight vector
for all of them; x holds which words and word beginnings a text has. The model is fitted
on a bounded sample of labelled documents; every document is scored by its whole text.
Labels of toxic or not are refined to grades first: toxic documents are split by how many
of the features that speak for toxicity they have.

Defined results: a null or empty text has no features and the severity that the
thresholds give; without labelled documents of both kinds nothing is rejected; rows with
equal ids are scored one by one; an empty table gives no rows; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.llm import vec

#: Labelled documents that the model is fitted on, at most; those with the smallest hashes of their ids.
FIT_ROWS = 6_000
GRADES = 4
#: A document is rejected when it is at least this likely to be of grade 1 or more.
REJECT = 0.5
#: Bytes of the word beginnings that count as features, besides whole words.
BEGINNINGS = (3, 4, 5, 6)
#: A feature speaks for toxicity, and takes part, from this many documents, this log odds ratio and this many of its standard errors on;
#: weaker ones only add up to noise in long texts.
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 5, 3.0, 3.3
MOST_FEATURES = 50_000


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit feature of every word and word beginning; repeats included."""
    starts, ends, first = vec.spans(buf, offsets, vec.LETTERS)
    text = vec.owners(first)
    owner, out = [text], [vec.hashes(buf, starts, ends)]
    for n in BEGINNINGS:
        some = ends - starts > n
        a = starts[some]
        owner.append(text[some])
        out.append(vec.scramble(vec.hashes(buf, a, a + n) + np.uint64(n)))
    return np.concatenate(owner), np.concatenate(out)


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])][:len(owner)]
    return owner[new], feature[new]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class OrdinalModel:
    """Weights of sorted features, and the thresholds."""

    def __init__(self, feature: np.ndarray, weight: np.ndarray, thresholds: np.ndarray):
        self.feature, self.weight, self.thresholds = feature, weight, thresholds
        self.mask = np.uint64((1 << 20) - 1)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(feature & self.mask).astype(np.int64)] = True

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of every score."""
        return _logistic(score[:, None] - self.thresholds[None, :])

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """w.x of every text."""
        owner, feature = features(buf, offsets)
        some = np.flatnonzero(self.seen[(feature & self.mask).astype(np.int64)])
        owner, feature = owner[some], feature[some]
        at = np.minimum(np.searchsorted(self.feature, feature), max(len(self.feature) - 1, 0))
        have = self.feature[at] == feature if len(self.feature) else np.zeros(len(at), bool)
        owner, at = owner[have], at[have]
        owner, at = _distinct(owner, at.astype(np.uint64))
        return np.bincount(owner, self.weight[at.astype(np.int64)], len(offsets) - 1)


def fit_ordinal(owner: np.ndarray, column: np.ndarray, grade: np.ndarray, n_columns: int, steps: int = 1000,
                rate: float = 0.1, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the most likely model, by Adam over all rows; entries are 1 at (owner, column)."""
    k = int(grade.max())
    share = np.array([(grade >= j).mean() for j in range(1, k + 1)])
    first = -np.log(share / (1 - share))
    # thresholds as a first one and the logarithms of the steps, so they keep their order
    x = np.concatenate([np.zeros(n_columns), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    rows = np.arange(len(grade))
    for step in range(1, steps + 1):
        w, cut = x[:n_columns], np.cumsum(np.r_[x[n_columns], np.exp(x[n_columns + 1:])])
        score = np.bincount(owner, w[column], len(grade))
        p = np.c_[np.ones(len(grade)), _logistic(score[:, None] - cut[None, :]), np.zeros(len(grade))]
        d = p * (1 - p)
        mass = np.maximum(p[rows, grade] - p[rows, grade + 1], 1e-12)
        # derivative of the mean log likelihood by the score and by each threshold
        by_score = (d[rows, grade] - d[rows, grade + 1]) / mass / len(grade)
        by_cut = np.zeros(k)
        lower, upper = grade > 0, grade < k
        np.add.at(by_cut, grade[lower] - 1, -d[rows, grade][lower] / mass[lower] / len(grade))
        np.add.at(by_cut, grade[upper], d[rows, grade + 1][upper] / mass[upper] / len(grade))
        after = np.cumsum(by_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(column, by_score[owner], n_columns) - ridge * w, after[:1], after[1:] * np.exp(x[n_columns + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return x[:n_columns], np.cumsum(np.r_[x[n_columns], np.exp(x[n_columns + 1:])])


def _no_model() -> OrdinalModel:
    return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.full(GRADES - 1, 40.0))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = FIT_ROWS) -> OrdinalModel:
    """Model of a bounded sample of labelled documents."""
    sample = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("_id"), (F.col(label) > 0).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_y").limit(rows)
    # of several texts with one id the one with the smallest hash, so there are no more than labels
    picked = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(sample), "_id").groupBy("_id", "_y").agg(
        F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                owner, feature = _distinct(*features(buf, offsets))
                bounds = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(bounds), vec.ints(feature))], ["y", "f"])

    got = picked.mapInArrow(run, "y int, f array<long>").toArrow()
    y = got.column("y").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    lists = got.column("f").combine_chunks()
    if len(y) == 0 or y.min() == y.max():
        return _no_model()
    flat = lists.flatten().to_numpy().view(np.uint64)
    owner = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy())
    vocabulary, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    toxic_df = np.bincount(column, y[owner], len(vocabulary))
    n1, n0 = y.sum(), len(y) - y.sum()
    a, b = toxic_df + 0.5, df - toxic_df + 0.5
    odds = np.log(a / (n1 - toxic_df + 0.5)) - np.log(b / (n0 - (df - toxic_df) + 0.5))
    z = odds / np.sqrt(1 / a + 1 / b + 1 / (n1 - toxic_df + 0.5) + 1 / (n0 - (df - toxic_df) + 0.5))
    z[(df < LEAST_DOCS) | (odds < LEAST_ODDS)] = 0
    strong = np.flatnonzero(z >= LEAST_Z)
    strong = np.sort(strong[np.argsort(-z[strong], kind="stable")[:MOST_FEATURES]])
    number = np.full(len(vocabulary), -1)
    number[strong] = np.arange(len(strong))
    column = number[column]
    owner, column = owner[column >= 0], column[column >= 0]
    # grades: toxic documents in equal parts by their number of these features
    speaks = np.bincount(owner, minlength=len(y))
    grade = np.zeros(len(y), np.int64)
    toxic = np.flatnonzero(y)
    rank = np.empty(len(toxic), np.int64)
    rank[np.argsort(speaks[toxic], kind="stable")] = np.arange(len(toxic))
    grade[toxic] = 1 + rank * (GRADES - 1) // len(toxic)
    if grade.max() < GRADES - 1:  # fewer toxic documents than grades
        grade[toxic] = GRADES - 1 - (len(toxic) - 1 - rank)
        grade = np.unique(grade, return_inverse=True)[1]
    w, cut = fit_ordinal(owner, column, grade, len(strong))
    return OrdinalModel(vocabulary[strong], w, cut)


def score(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Severity of every document; with ``keep`` the documents that are not rejected, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def grades(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return shared.value.at_least(shared.value.scores(buf, offsets))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, text):
                yield part.filter(pa.array(grades(buf, offsets)[:, 0] < REJECT))

    if keep:
        return docs.mapInArrow(clean, docs.schema)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                p = grades(buf, offsets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0]),
                    pa.array(p[:, 0] >= REJECT)], ["doc_id", "expected_severity", "grade", "p_toxic", "rejected"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(report, f"doc_id {kind}, expected_severity double, grade int, p_toxic double, rejected boolean")
