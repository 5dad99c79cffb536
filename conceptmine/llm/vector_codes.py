"""Codes of vectors by parts, with codebooks in whole numbers and equal-average search.

Components become floor(256 x). A vector is cut into equal consecutive parts; every part
position has a codebook of entries. It starts as that part of the vectors with the smallest
ids; each round assigns every part to its nearest entry and moves the entry to the floored
mean of its parts.

Nearest entries are found by equal-average search: entries are sorted by the sum of their
components, and a part looks outward from its own sum. By Cauchy and Schwarz
(sum x - sum c)^2 / dimension <= |x - c|^2, so a side is done as soon as its squared gap
over the dimension strictly exceeds the best distance; ties stay in, and the lower index wins.

Every pass streams the vectors past the broadcast codebooks, whose size is the number of
entries times the dimension. Tasks return one sum per part and entry.

Defined results: a row is left out if its vector is null or has null or non-finite
components; a vector of another length than that of the smallest id (an empty one too) has
null code and error and adds nothing to sums; rows with the same id take part one by one,
ordered by their vectors where the id decides; a null id comes last; null labels are one
label; an empty table gives no rows; further columns are never read. A component too large
for exact 64-bit errors is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.operators.skew import salted_join
from conceptmine.session import materialize

#: Parts of a vector, entries of a codebook, rounds of training; what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a worker handles at once.
ROWS = 4096

_HEX = np.array([f"{i:02x}" for i in range(256)], "U2")


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every row, ties to the lower index, and its squared distance."""
    n, dim = x.shape
    total = entries.sum(axis=1)
    order = np.argsort(total, kind="stable")
    sums, own = total[order], x.sum(axis=1)
    best, at = np.full(n, np.iinfo(np.int64).max // max(dim, 1)), np.zeros(n, np.int64)
    place = np.searchsorted(sums, own)
    sides = [(np.arange(n), place, 1), (np.arange(n), place - 1, -1)]
    while any(len(rows) for rows, _, _ in sides):
        for k, (rows, place, step) in enumerate(sides):
            inside = (place >= 0) & (place < len(entries))
            rows, place = rows[inside], place[inside]
            gap = sums[place] - own[rows]
            near = gap * gap <= best[rows] * dim
            rows, place = rows[near], place[near]
            entry = order[place]
            away = x[rows] - entries[entry]
            distance = (away * away).sum(axis=1)
            better = (distance < best[rows]) | ((distance == best[rows]) & (entry < at[rows]))
            best[rows[better]], at[rows[better]] = distance[better], entry[better]
            sides[k] = rows, place + step, step
    return at, best


def _whole(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole components; ``vectors`` all have ``dim`` of them."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    # squared distances and squared gaps of sums have to fit into 64 bits
    most = isqrt((2**63 - 1) // max(dim, (dim // PARTS) ** 2)) // 2
    if len(x) and np.abs(x).max() > most:
        raise ValueError(f"a component beyond {most / SCALE:g} has no exact error in 64 bits")
    return x.astype(np.int64).reshape(-1, dim)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def first_codebooks(rows: DataFrame, entries: int = ENTRIES) -> np.ndarray | None:
    """Codebooks (part, entry, component) of the vectors with the smallest ids; None without a vector."""
    some = rows.where(F.size("_vec") > 0)
    lead = some.orderBy(F.col("vec_id").asc_nulls_last(), "_vec").select(F.size("_vec").alias("n")).first()
    if lead is None:
        return None
    if lead.n % PARTS:
        raise ValueError(f"vectors of {lead.n} components can't be cut into {PARTS} equal parts")
    top = some.where(F.size("_vec") == lead.n).orderBy(F.col("vec_id").asc_nulls_last(), "_vec").limit(entries)
    whole = _whole(top.select("_vec").toArrow()["_vec"].combine_chunks(), lead.n)
    return whole.reshape(len(whole), PARTS, -1).swapaxes(0, 1)


def better_codebooks(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry moved to the floored mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = books.shape
    dim = parts * width
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        number, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in _slices(batches):
            x = _whole(batch.column(0), dim).reshape(-1, parts, width)
            for p in range(parts):
                at, _ = nearest(x[:, p], books[p])
                number[p] += np.bincount(at, minlength=entries)
                np.add.at(sums[p], at, x[:, p])
        p, e = np.nonzero(number)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(number[p, e]), *[pa.array(sums[p, e, i]) for i in range(width)]],
            ["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    columns = ["n", *[f"s{i}" for i in range(width)]]
    same = rows.where(F.size("_vec") == dim).select("_vec")
    found = same.mapInArrow(add, "part long, entry long, " + ", ".join(f"{c} long" for c in columns))
    # one row per part and entry
    total = found.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = books.copy()
    sums = np.stack([total[f"s{i}"].to_numpy() for i in range(width)], axis=1)
    out[total["part"].to_numpy(), total["entry"].to_numpy()] = sums // total["n"].to_numpy()[:, None]
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``code`` (two hex digits a part) and ``error`` instead of the vector."""
    parts, entries, width = books.shape
    dim = parts * width
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            vectors = batch.column(2)
            fits = vectors.value_lengths().to_numpy(zero_copy_only=False) == dim
            x = _whole(vectors.filter(pa.array(fits)), dim).reshape(-1, parts, width)
            code, error = np.zeros((batch.num_rows, parts), np.int64), np.zeros(batch.num_rows, np.int64)
            for p in range(parts):
                at, distance = nearest(x[:, p], shared.value[p])
                code[fits, p] = at
                error[fits] += distance
            text = np.ascontiguousarray(_HEX[code]).view(f"U{2 * parts}").ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, mask=~fits), pa.array(error, mask=~fits)],
                ["vec_id", "label", "code", "error"])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]
    return rows.mapInArrow(run, ", ".join([*kinds, "code string", "error long"]))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
             entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` (errors of all rows of the label), ``codebooks_sha256``, ``label``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("_vec"))
    books = first_codebooks(rows, entries)
    if books is None:
        # no vector with a component: nothing to learn from, and no codes
        books = np.zeros((PARTS, 0, 1), np.int64)
    for _ in range(rounds if books.shape[1] else 0):
        books = better_codebooks(rows, books)
    # null labels are a label too
    same = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("_same")
    coded = materialize(codes(rows, books).select("*", same))
    sums = coded.groupBy("_same").agg(F.sum("error").alias("label_error"))
    return salted_join(coded, sums, "_same").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"), "label")
