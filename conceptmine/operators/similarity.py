"""Exact cosine threshold joins, partitioned by Spark.

A right side of bounded size (checked by row count and width) is broadcast and left rows
stream past it. Beyond that, both sides are dealt to pairs of blocks: a task keeps one block of
left rows and lets a slice of right rows stream past, batch by batch. Left blocks are as large as a
task can hold, so a right row goes to few of them.

Pivots may cut the space into cells first. A left row lives in the cell of its nearest pivot;
a right row is needed in every cell that can hold a partner: with unit vectors, cos >= t means
a distance of at most r = sqrt(2 - 2t), and the triangle inequality gives

    d(right, pivot) <= min over pivots of d(right, .) + 2 r
    d(right, pivot) <= radius of the cell's left rows + r.

Cells are used where a count of those rows shows that they save work; at low thresholds they
don't, and the blocks of one cell hold everything.

Within a block pair the leading components alone give a bound by Cauchy and Schwarz,
a . b <= a_head . b_head + |a_rest| |b_rest|, and few pairs are left to compute in full.

Pairs of one table come from a triangle of block pairs: each pair of rows is computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.functions import vectors as vx

MAX_BROADCAST_VALUES = 2_000_000  # doubles, 16 MB; every worker holds them, and their unit vectors
RESIDENT_VALUES = 4_000_000  # components of a left block that a task keeps
SLICE_VALUES = 1_000_000  # products held at once by a worker
SLICE_ROWS = 256  # rows that pass a block at once, where they come: products of fewer are slower one by one
PAIR_VALUES = 250_000  # components of pairs computed in full, or distances to pivots, at once
BLOCK_ROWS = 2048  # rows of a block at least, where there are as many
CELL_SHARE = 4  # cells must leave at most one in so many products
HEAD_SHARE, HEAD_DIM = 8, 128  # leading components are one in so many, of vectors from this width on
SLACK = 1e-5  # wider than single-precision error: candidates are decided on the exact double value


def prepared(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``(id, vec)`` of the rows that have a direction; the others can match nothing.

    Single-precision vectors stay so on the wire, arithmetic is in doubles.
    """
    out = df.select(F.col(key).alias("id"), F.col(vec).alias("vec"))
    length = vx.norm(vx.as_double(F.col("vec")))
    return out.where((length > 0) & ~F.isnan(length))


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class Side:
    """One side of a block pair: vectors, their lengths, and unit vectors for the first cut."""

    def __init__(self, vectors: np.ndarray, resident: bool = True) -> None:
        self.vectors = vectors
        self.lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
        self.unit = (vectors / self.lengths[:, None]).astype(np.float32)
        dim = vectors.shape[1]
        self.head = None
        if resident and dim >= HEAD_DIM:
            # the components that carry most of these vectors
            self.head = np.argsort(-np.einsum("ij,ij->j", self.unit, self.unit), kind="stable")[:dim // HEAD_SHARE]
            self.lead, self.rest = _cut(self.unit, self.head)

    def __len__(self) -> int:
        return len(self.vectors)

    def __getitem__(self, rows) -> Side:
        part = object.__new__(Side)
        part.vectors, part.lengths, part.unit, part.head = self.vectors[rows], self.lengths[rows], self.unit[rows], self.head
        if self.head is not None:
            part.lead, part.rest = self.lead[rows], self.rest[rows]
        return part


def _cut(unit: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading components, and the length of what is left of each vector."""
    lead = np.ascontiguousarray(unit[:, head])
    return lead, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", lead, lead))).astype(np.float32)


def _candidates(a: Side, b: Side, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that can reach the threshold."""
    if b.head is not None:
        lead, rest = _cut(a.unit, b.head)
        bound = lead @ b.lead.T
        bound += rest[:, None] * b.rest[None, :]
        near = bound >= t - SLACK
        # one pair costs as much alone as some thirty in a matrix product
        if np.count_nonzero(near) * 32 <= near.size:
            return _true(near)
    return _true(_products(a.unit, b.unit) >= t - SLACK)


@cache
def _room(values: int) -> np.ndarray:
    return np.empty(values, dtype=np.float32)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T``, in memory that the next call uses again: new pages cost as much as the products."""
    size = len(a) * len(b)
    return np.matmul(a, b.T, out=_room(SLICE_VALUES)[:size].reshape(len(a), len(b))) if size <= SLICE_VALUES else a @ b.T


def _true(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix where little is true: eight values are looked at as one."""
    flat = near.reshape(-1)
    whole = len(flat) & ~7
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    places = np.flatnonzero(flat[:whole].reshape(-1, 8)[words])
    at = np.concatenate([words[places >> 3] * 8 + (places & 7), whole + np.flatnonzero(flat[whole:])])
    return np.divmod(at, max(1, near.shape[1]))


def hits(a: Side, b: Side, t: float, strict: bool):
    """Index pairs (by row, then column) and scores of the pairs that reach the threshold."""
    i, j = _candidates(a, b, t)
    score = np.empty(len(i))
    # exact values of a bounded number of pairs at a time, whatever the dimension
    step = max(1, PAIR_VALUES // (4 * a.vectors.shape[1]))
    for at in range(0, len(i), step):
        x, y = i[at:at + step], j[at:at + step]
        pairs = np.take(a.vectors, x, axis=0).astype(np.float64, copy=False)
        pairs *= np.take(b.vectors, y, axis=0).astype(np.float64, copy=False)
        score[at:at + step] = pairs.sum(axis=1) / (a.lengths[x] * b.lengths[y])
    keep = score > t if strict else score >= t
    return i[keep], j[keep], score[keep]


def shape(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    return row["n"], row["dim"] or 0


class Pairs:
    """Pairs of a resident block with rows that come past: the work of one block pair."""

    def __init__(self, ids: pa.Array, side: Side, t: float, strict: bool, names: tuple[str, str] = ("left_id", "right_id"),
                 once: bool = False):
        self.ids, self.side, self.t, self.strict, self.names, self.once = ids, side, t, strict, names, once
        #: with ``once`` ids are numbers in ascending order
        self.order = ids.to_numpy() if once else None

    def feed(self, ids: pa.Array, vectors: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of the given rows with the block; of the block's ``own`` rows only the pairs with smaller ids."""
        step = max(SLICE_ROWS, SLICE_VALUES // max(1, len(self.side)))
        for start in range(0, len(ids), step):
            some = ids.slice(start, step)
            passing = Side(vectors[start:start + step], resident=False)
            most = len(self.side)
            if own:
                order = some.to_numpy()
                most = int(np.searchsorted(self.order, order.max()))
            width = max(1, SLICE_VALUES // len(some))
            for first in range(0, most, width):
                i, j, score = hits(passing, self.side[first:min(first + width, most)], self.t, self.strict)
                j += first
                if own:
                    earlier = self.order[j] < order[i]
                    i, j, score = i[earlier], j[earlier], score[earlier]
                x, y = self.ids.take(pa.array(j)), some.take(pa.array(i))
                if self.once:
                    x, y = (pa.array(f(x.to_numpy(), y.to_numpy())) for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([x, y, pa.array(score)], [*self.names, "score"])

    def finish(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def similarity_join(
    left: DataFrame, right: DataFrame, threshold: float, strict: bool = False,
    left_key: str = "id", right_key: str = "id", left_vec: str = "vec", right_vec: str = "vec",
    max_broadcast_values: int = MAX_BROADCAST_VALUES,
) -> DataFrame:
    """All pairs with cosine >= threshold (> if strict): ``(left_id, right_id, score)``.

    Keys must be unique per side: join distinct texts, then join their uses
    back. Both inputs are read more than once; pass written tables when the
    vectors come from an encoder.
    """
    a, b = prepared(left, left_key, left_vec), prepared(right, right_key, right_vec)
    schema = f"left_id {_type(a, 'id')}, right_id {_type(b, 'id')}, score double"
    rows, dim = shape(b)
    if rows == 0:
        return left.sparkSession.createDataFrame([], schema)
    if rows * dim > max_broadcast_values:
        return block_join(a, b, dim, threshold, lambda ids, side: Pairs(ids, side, threshold, strict), schema)
    table = b.toArrow()  # at most max_broadcast_values doubles, checked
    small = b.sparkSession.sparkContext.broadcast((table["id"].combine_chunks(), matrix(table["vec"], dim)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = small.value
        block = Pairs(ids, Side(vectors), threshold, strict, ("right_id", "left_id"))
        for batch in batches:
            for found in block.feed(batch.column("id"), matrix(batch.column("vec"), dim), False):
                yield found.select(["left_id", "right_id", "score"])

    return a.mapInArrow(match, schema)


def similar_pairs(df: DataFrame, threshold: float, key: str = "ord", vec: str = "vec",
                  max_broadcast_values: int = MAX_BROADCAST_VALUES) -> DataFrame:
    """Pairs ``(a, b, score)`` of one table with ``a < b`` and cosine strictly above the threshold; ``key`` is a whole number."""
    rows = prepared(df, key, vec).withColumn("id", F.col("id").cast("bigint"))
    n, dim = shape(rows)
    schema = "a bigint, b bigint, score double"
    if n == 0:
        return df.sparkSession.createDataFrame([], schema)

    def pairs(ids: pa.Array, side: Side) -> Pairs:
        return Pairs(ids, side, threshold, True, ("a", "b"), once=True)

    if n * dim > max_broadcast_values:
        return block_join(rows, rows, dim, threshold, pairs, schema, once=True)
    table = rows.toArrow().sort_by("id")  # at most max_broadcast_values doubles, checked
    small = df.sparkSession.sparkContext.broadcast((table["id"].combine_chunks(), matrix(table["vec"], dim)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = small.value
        block = pairs(ids, Side(vectors))
        for batch in batches:
            yield from block.feed(batch.column("id"), matrix(batch.column("vec"), dim), True)

    # in order, so that a batch meets only the rows before it
    return rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(match, schema)


# --- block pairs ------------------------------------------------------------------------

def _with_cells(df: DataFrame, pivots: np.ndarray, choose, vectors: bool = True) -> DataFrame:
    """One row per (row, cell) that ``choose(distances)`` marks; adds ``cell``, ``dist`` and ``home``, the nearest cell."""
    shared = df.sparkSession.sparkContext.broadcast(_unit(pivots))
    names = ["id", *["vec"] * vectors]
    schema = ", ".join([*[f"{c} {_type(df, c)}" for c in names], "cell int", "dist double", "home int"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        step = max(1, PAIR_VALUES // len(p))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                u = _unit(matrix(part.column("vec"), p.shape[1]).astype(np.float64, copy=False))
                dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (u @ p.T)))
                row, cell = np.nonzero(choose(dist))
                picked = part.select(names).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*picked.columns, pa.array(cell.astype(np.int32)), pa.array(dist[row, cell]),
                     pa.array(dist.argmin(axis=1)[row].astype(np.int32))], [*names, "cell", "dist", "home"])

    return df.mapInArrow(assign, schema)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _nearest(dist: np.ndarray) -> np.ndarray:
    return np.arange(dist.shape[1]) == dist.argmin(axis=1)[:, None]


def _cells(a: DataFrame, b: DataFrame, a_rows: int, b_rows: int, dim: int, t: float, once: bool):
    """Rows with their cells and the counts of both sides, or None where cells would not save enough work."""
    # pivots grow with the root of the table, within the broadcast budget, and stay near
    # the number of blocks: more cells than that only add copies
    wanted = int(min(b_rows ** 0.5, 4 * b_rows / BLOCK_ROWS, MAX_BROADCAST_VALUES / dim))
    if wanted < 2:
        return None
    top = b.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(wanted).toArrow()
    pivots = matrix(top["vec"], dim).astype(np.float64, copy=False)
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * t))) + 1e-6

    homes = _with_cells(a, pivots, _nearest)
    # one row per pivot
    left = homes.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).toPandas()
    radius = np.full(len(pivots), -np.inf)
    radius[left["cell"]] = left["radius"]

    def can_match(dist: np.ndarray) -> np.ndarray:
        near = (dist <= dist.min(axis=1, keepdims=True) + 2 * reach) & (dist <= radius + reach)
        # a pair of one table is looked for in the cell with the lower number
        return near & (np.arange(len(radius)) <= dist.argmin(axis=1)[:, None]) if once else near

    right = _with_cells(b, pivots, can_match, vectors=False).groupBy("cell").agg(F.count("*").alias("n")).toPandas()
    sizes = left[["cell", "n"]].merge(right, on="cell", suffixes=("_left", "_right"))
    work = (sizes["n_left"].astype("float64") * sizes["n_right"]).sum()
    if work * CELL_SHARE > a_rows * b_rows / (2 if once else 1):
        return None
    return homes.drop("dist", "home"), _with_cells(b, pivots, can_match).drop("dist"), sizes


def block_join(a: DataFrame, b: DataFrame, dim: int, t: float, work: Callable, schema: str, once: bool = False) -> DataFrame:
    """Pass every right row by all left blocks that can hold a match.

    ``work(ids, side)`` makes the consumer of a left block, sorted by id: ``feed(ids, vectors, own)`` is
    called with right rows sorted by id, ``finish()`` at their end. With ``once`` both sides are the
    same table, and two blocks meet once; a block meets its ``own`` rows too.
    """
    spark = a.sparkSession
    a_rows, b_rows = a.count(), b.count()
    if not a_rows or not b_rows:
        return spark.createDataFrame([], schema)
    cells = _cells(a, b, a_rows, b_rows, dim, t, once)
    if cells is None:
        cell = F.lit(0).alias("cell")
        lefts, rights = a.select("id", "vec", cell), b.select("id", "vec", cell, F.lit(0).alias("home"))
        sizes = pd.DataFrame({"cell": [0], "n_left": [a_rows], "n_right": [b_rows]})
    else:
        lefts, rights, sizes = cells
    if sizes.empty:
        return spark.createDataFrame([], schema)

    # work of a task: enough tasks for all cores, blocks of at least BLOCK_ROWS, a resident block that fits
    cores = spark.sparkContext.defaultParallelism
    total = float((sizes["n_left"].astype("float64") * sizes["n_right"]).sum())
    keep = max(1, RESIDENT_VALUES // dim)
    block = int(min(keep, max(BLOCK_ROWS, sqrt(total / (4 * cores)))))
    pass_by = int(max(BLOCK_ROWS, min(8 * keep, total / (4 * cores) / block)))
    grid = pd.DataFrame({
        "cell": sizes["cell"].astype("int32"),
        "blocks": np.ceil(sizes["n_left"] / block).astype("int32"),
        "slices": np.ceil(sizes["n_right"] / pass_by).astype("int32"),
    })
    pairs = grid["blocks"].astype("int64") * grid["slices"]
    grid["first"] = pairs.cumsum() - pairs  # number of a cell's first block pair
    tasks = int(pairs.sum())
    tasks = min(tasks, max(cores, ceil(tasks / 8)))
    grid = F.broadcast(spark.createDataFrame(grid))  # one row per pivot

    def every(n: str, last=None):
        return F.explode(F.sequence(F.lit(0), (F.col(n) - 1) if last is None else last))

    own_block, own_slice = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("slices")).cast("int")
    # rows of a cell go to its blocks up to their own one where pairs are wanted once; rows of other cells to all
    at_home = (F.col("home") == F.col("cell")) if once else F.lit(False)
    keys = ["id", "vec", "cell", "block", "slice", "comes", (F.col("first") + F.col("block").cast("bigint") * F.col("slices") + F.col("slice")).alias("number")]
    lefts = lefts.join(grid, "cell").select(
        "id", "vec", "cell", own_block.alias("block"), every("slices").alias("slice"), "slices", "first", F.lit(0).alias("comes")).select(*keys)
    rights = rights.join(grid, "cell").withColumn("last", F.when(at_home, own_block).otherwise(F.col("blocks") - 1)).select(
        "id", "vec", "cell", every("blocks", F.col("last")).alias("block"), own_slice.alias("slice"), "slices", "first", "last", at_home.alias("home"))
    rights = rights.withColumn("comes", F.when(F.col("home") & (F.col("block") == F.col("last")), 2).otherwise(1)).select(*keys)
    pair = F.shiftleft(F.col("cell").cast("bigint"), 40) + F.shiftleft(F.col("block").cast("bigint"), 20) + F.col("slice")
    # block pairs are dealt out in turn: by hash a task of few gets twice its share
    both = lefts.unionByName(rights).select("id", "vec", pair.alias("pair"), "comes", (F.col("number") % tasks).cast("int").alias("task"))
    both = both.repartitionById(tasks, "task").drop("task")
    return both.sortWithinPartitions("pair", "comes", "id").mapInArrow(_runner(work, dim), schema)


def _runner(work: Callable, dim: int):
    """Rows sorted by (pair, comes, id): a left block (0), then right rows of others (1) and of the block's own (2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, consumer = None, [], None
        for batch in batches:
            pair, comes = batch.column("pair").to_numpy(), batch.column("comes").to_numpy()
            cuts = np.r_[0, np.flatnonzero((pair[1:] != pair[:-1]) | (comes[1:] != comes[:-1])) + 1, len(pair)]
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if begin == end:
                    continue
                if pair[begin] != now:
                    if consumer is not None:
                        yield from consumer.finish()
                    now, held, consumer = pair[begin], [], None
                part = batch.slice(begin, end - begin).select(["id", "vec"])
                if comes[begin] == 0:
                    held.append(part)
                    continue
                if not held and consumer is None:
                    continue  # a slice for a block without rows
                if consumer is None:
                    table = pa.Table.from_batches(held)
                    ids, vectors = table["id"].combine_chunks(), matrix(table["vec"], dim)
                    held, table = [], None
                    consumer = work(ids, Side(vectors))
                yield from consumer.feed(part.column("id"), matrix(part.column("vec"), dim), bool(comes[begin] == 2))
        if consumer is not None:
            yield from consumer.finish()

    return run
