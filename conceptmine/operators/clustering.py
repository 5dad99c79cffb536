"""Greedy leader clustering of vectors, in rounds that only move ids.

The sequential loop lets each still free row take all later free rows with a cosine over the
threshold. Its leaders are the rows without an earlier leader nearby, and every other row
belongs to its smallest leader neighbour. So a row leads when all earlier neighbours are
members, and is a member as soon as one of them leads.

One pass over the vectors lists the earlier neighbours of each row; all rounds after it are joins of
ids. A row with a single open earlier neighbour is the opposite of it: such rows point
to that neighbour, and pointers are doubled in every round, so a chain of n rows takes about
log2 n rounds. A row next to very many others lists only the smallest of them: usually one of
these leads. If none does, rows that are still free are listed anew, among themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.functions import vectors as vx
from conceptmine.operators.similarity import MAX_BROADCAST_VALUES, SLICE_VALUES, Side, block_join, hits, matrix, shape
from conceptmine.operators.skew import salted_join
from conceptmine.session import materialize

#: Earlier neighbours listed for a row (by each block it meets): at least so many, more while all lists are no longer than that together.
LEAST_LISTED, LISTED = 8, 4_000_000
#: Right rows looked at before rows with a full list are left out.
STEP = 512


class Earlier:
    """Collects the smallest earlier neighbours of the rows of a block; right rows come past in ascending order."""

    def __init__(self, ids: pa.Array, side: Side, t: float, most: int):
        self.ids, self.side, self.t, self.most = ids.to_numpy(), side, t, most
        self.have = np.zeros(len(self.ids), np.int64)

    def open_rows(self, after: int) -> np.ndarray:
        """Rows that still look for neighbours, and have an id beyond ``after``."""
        first = int(np.searchsorted(self.ids, after, "right"))
        return first + np.flatnonzero(self.have[first:] <= self.most)

    def meet(self, ids: np.ndarray, side: Side) -> Iterator[pa.RecordBatch]:
        every = self.open_rows(ids[0])
        # a bounded number of products at a time, however many rows the block has
        step = max(1, SLICE_VALUES // len(ids))
        for at in range(0, len(every), step):
            rows = every[at:at + step]
            i, j, _ = hits(self.side[rows], side, self.t, True)
            v, u = rows[i], ids[j]
            earlier = u < self.ids[v]
            # ordered by row, then by id: the place in a row's list
            v, u = v[earlier], u[earlier]
            place = self.have[v] + np.arange(len(v)) - np.searchsorted(v, v)
            self.have += np.bincount(v, minlength=len(self.have))
            keep = place < self.most
            yield _listed(self.ids[v[keep]], pa.array(u[keep]))

    def feed(self, ids: pa.Array, vectors: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        ids = ids.to_numpy()
        for start in range(0, len(ids), STEP):
            part = slice(start, start + STEP)
            yield from self.meet(ids[part], Side(vectors[part], resident=False))

    def finish(self) -> Iterator[pa.RecordBatch]:
        """A null for every row that has more neighbours than listed."""
        more = self.ids[self.have > self.most]
        yield _listed(more, pa.nulls(len(more), pa.int64()))


def _listed(v: np.ndarray, u: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v), u], ["v", "u"])


def earlier_neighbours(left: DataFrame, right: DataFrame, right_rows: int, dim: int, t: float, most: int,
                       max_broadcast_values: int) -> DataFrame:
    """``(v, u)``: for rows v of left the smallest ``most`` rows u < v of right with cosine > t; u is null if there are more.

    More than ``most`` are listed where several blocks of right hold some.
    """
    schema = "v bigint, u bigint"
    if not right_rows:
        return left.sparkSession.createDataFrame([], schema)
    if right_rows * dim > max_broadcast_values:
        return block_join(left, right, dim, t, lambda ids, side: Earlier(ids, side, t, most), schema)
    table = right.select("id", "vec").toArrow().sort_by("id")  # at most max_broadcast_values doubles, checked
    shared = left.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), matrix(table["vec"], dim)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        side = Side(vectors, resident=False)
        for batch in batches:
            batch = batch.sort_by("id")
            block = Earlier(batch.column("id"), Side(matrix(batch.column("vec"), dim), resident=False), t, most)
            for start in range(0, len(ids), STEP):
                yield from block.meet(ids[start:start + STEP], side[start:start + STEP])
            yield from block.finish()

    return left.mapInArrow(match, schema)


def _start(free: DataFrame, near: DataFrame) -> DataFrame:
    """State of each row: ``lead`` (null while open), whether its list is ``whole``, and what it points to.

    A row that points somewhere (``ptr``) is what that row is, or the opposite of it (``flip``).
    """
    lists = near.groupBy(F.col("v").alias("id")).agg(
        F.count("u").alias("n"), F.bool_and(F.col("u").isNotNull()).alias("whole"), F.max("u").alias("u"))
    one = F.col("whole") & (F.col("n") == 1)
    return free.select("id").join(lists, "id", "left").select(
        "id", F.when(F.col("n").isNull(), True).alias("lead"), F.coalesce("whole", F.lit(True)).alias("whole"),
        F.when(one, F.col("u")).alias("ptr"), F.lit(True).alias("flip"))


def _step(state: DataFrame, near: DataFrame) -> DataFrame:
    """One round: open rows look at their listed neighbours, or at the row they point to, whose pointer they take over."""
    seen = state.select(F.col("id").alias("u"), F.col("lead").alias("u_lead"), F.col("ptr").alias("u_ptr"), F.col("flip").alias("u_flip"))
    decided, open_ = state.where("lead IS NOT NULL"), state.where("lead IS NULL")

    pointing = open_.where("ptr IS NOT NULL").join(seen, F.col("ptr") == F.col("u"))
    on = F.col("u_lead").isNull() & F.col("u_ptr").isNotNull()
    pointing = pointing.select(
        "id", (F.col("u_lead") != F.col("flip")).alias("lead"), "whole", F.when(on, F.col("u_ptr")).otherwise(F.col("ptr")).alias("ptr"),
        F.when(on, F.col("flip") != F.col("u_flip")).otherwise(F.col("flip")).alias("flip"))

    listing = open_.where("ptr IS NULL").select("id", "whole")
    around = near.where("u IS NOT NULL").join(listing, F.col("v") == F.col("id")).join(seen, "u").groupBy("id", "whole").agg(
        F.coalesce(F.bool_or("u_lead"), F.lit(False)).alias("led"), F.count_if(F.col("u_lead").isNull()).alias("n"),
        F.max(F.when(F.col("u_lead").isNull(), F.col("u"))).alias("u"))
    listing = around.select(
        "id", F.when(F.col("led"), False).when(F.col("whole") & (F.col("n") == 0), True).alias("lead"), "whole",
        F.when(F.col("whole") & (F.col("n") == 1) & ~F.col("led"), F.col("u")).alias("ptr"), F.lit(True).alias("flip"))
    return decided.unionByName(pointing).unionByName(listing)


def _settle(free: DataFrame, near: DataFrame, log) -> tuple[DataFrame, int]:
    """State of all rows when nothing more follows from the lists, and the number of open rows."""
    state, before, rounds = materialize(_start(free, near)), None, 0
    while True:
        row = state.agg(F.count_if(F.col("lead").isNull()).alias("n"), F.bit_xor(F.when(
            F.col("lead").isNull(), F.xxhash64("id", "ptr"))).alias("h")).first()
        rounds += 1
        if log:
            log(f"leader clustering round {rounds}: {row.n} rows free")
        if not row.n or row == before:
            return state, row.n
        before, state = row, materialize(_step(state, near))


def leader_clusters(
    df: DataFrame, threshold: float = 0.95, max_broadcast_values: int = MAX_BROADCAST_VALUES, log=None,
) -> DataFrame:
    """``df(ord bigint, vec)`` to ``(ord, leader)`` of the sequential greedy clustering.

    Equal vectors collapse to their earliest row first (exact, they share all neighbours).
    Every listing settles at least the earliest free row. Nothing is cut short.
    """
    if not threshold < 1.0:
        raise ValueError("threshold must be below 1")
    length = F.coalesce(vx.norm(vx.as_double(F.col("vec"))), F.lit(0.0))
    blank = (length == 0) | F.isnan(length)
    rows = df.select(F.col("ord").cast("bigint").alias("ord"), "vec")
    # vectors are told apart by 128 bits; they themselves move once
    keys = materialize(rows.select("ord", F.when(~blank, F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b"))).alias("key")))
    # a row without direction is similar to nothing, not even to its copies
    alone = keys.where("key IS NULL").select("ord", F.col("ord").alias("leader"))
    solid = keys.where("key IS NOT NULL")
    kinds = materialize(solid.groupBy("key").agg(F.min("ord").alias("id")))
    points = materialize(rows.join(kinds.select(F.col("id").alias("ord")), "ord").select(F.col("ord").alias("id"), "vec").dropDuplicates(["id"]))

    count, dim = shape(points)
    free, left_over, leaders, lists = points, count, None, None
    while left_over:
        most = max(LEAST_LISTED, LISTED // left_over)
        near = materialize(earlier_neighbours(free, free, left_over, dim, threshold, most, max_broadcast_values))
        state, left_over = _settle(free, near, log)
        lists = lists or (near, state.select("id", "whole"))
        found = state.where("lead").select("id")
        leaders = found if leaders is None else materialize(leaders.union(found))
        if left_over:
            # rows with long lists: first away with those next to any new leader
            rest = materialize(points.join(state.where("lead IS NULL"), "id", "left_semi"))
            new = materialize(points.join(found, "id", "left_semi"))
            led = earlier_neighbours(rest, new, new.count(), dim, threshold, 1, max_broadcast_values)
            free = materialize(rest.join(led.select(F.col("v").alias("id")), "id", "left_anti"))
            left_over = free.count()

    owners = kinds.select("key", "id")
    if count:
        # the smallest leader nearby: from the first list where it is whole, by another look where it isn't
        near, whole = lists
        led = near.join(leaders.select(F.col("id").alias("u")), "u")
        short = whole.where("NOT whole").select("id")
        if not short.isEmpty():
            heads = materialize(points.join(leaders, "id", "left_semi"))
            again = points.join(short, "id", "left_semi")
            led = led.join(short.select(F.col("id").alias("v")), "v", "left_anti").unionByName(
                earlier_neighbours(again, heads, heads.count(), dim, threshold, 1, max_broadcast_values).where("u IS NOT NULL"))
        owners = owners.join(led.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("u")), "id", "left")
        owners = owners.select("key", F.coalesce("u", "id").alias("leader"))
    else:
        owners = owners.select("key", F.col("id").alias("leader"))
    # one vector may be shared by a third of all rows
    return salted_join(solid, owners, "key").select("ord", "leader").unionByName(alone)
