"""Prefix trie of conversations, with subtree sums by the Euler-tour technique.

A node is a sequence of turns with which conversations begin. Its key is its depth and two
64-bit hashes: the exclusive or of a hash of each turn and its place, so that all prefixes
of a conversation come from one running total.

The trie is walked as an Euler tour: an enter and an exit arc for each node, each pointing
to the next arc: into the first child or the own exit, then to the next sibling or the exit
of the parent. The tour is ranked as a linked list; an enter arc carries what its node adds,
and the total of a subtree is the sum from its enter arc less the sum from its exit arc.

One conversation, or the children of one node, may be a third of all rows. Rows are numbered
within a key from a global sort cut by ranges, running totals go over slices of bounded
length with what came before added, and joins on such keys are salted. A digest is sequential:
one task hashes the ids in ``ends_sha256`` of a node, as a stream of texts that many tasks wrote.

Defined results: turns are ordered by turn (null first), then by a hash of role and text;
null role or text is empty; a row without conv_id belongs to no conversation; repeated rows
are turns of their own; an empty table has no trie and gives no rows; further columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptmine.llm.list_rank import suffix_sums
from conceptmine.operators.skew import salted_join
from conceptmine.session import materialize

#: Conversations of a block share the beginning of the block's first one: its first crc32(id) % SHARED turns.
BLOCK, SHARED = 100, 6
#: Longest stretch of a conversation, or of a path in the trie, that one task handles at once.
STRETCH = 4096

_KEY = ["depth", "k1", "k2"]


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place of each row among those of its key, from 0; nulls first.

    Rows are sorted over all tasks, so a key with very many is in several; each task counts its
    own, and the rows of a key in tasks before are added.
    """
    spread = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    spread = materialize(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    # a task goes on with one key of the task before at most: no more rows than tasks
    carried = counts.withColumn("_before", F.sum("_n").over(before)).where("_before IS NOT NULL").select(key, "_part", "_before")
    own = F.row_number().over(Window.partitionBy(key, "_part").orderBy("_at")) - 1
    return spread.withColumn("pos", own.cast("long")).join(F.broadcast(carried), [key, "_part"], "left").withColumn(
        "pos", F.col("pos") + F.coalesce("_before", F.lit(0))).drop("_part", "_at", "_before")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, ...) in the place they have after the first ones came from the block's first conversation.

    ``convs`` has ``conv_id``, ``base`` and ``h``, the turns that come from there.
    """
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < SHARED - 1)).withColumnRenamed("conv_id", "base")
    have = heads.groupBy("base").agg(F.count("*").alias("have"))
    convs = materialize(convs.join(have, "base", "left").withColumn("given", F.least("h", F.coalesce("have", F.lit(0)))).drop("have"))
    given = convs.join(heads, "base").where("pos < h").drop("base", "h", "given")
    own = salted_join(turns, convs.drop("base"), "conv_id").where("pos >= h").withColumn(
        "pos", F.col("pos") - F.col("h") + F.col("given")).drop("h", "given")
    return given.unionByName(own)


def prefix_keys(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, h1, h2, len) with the key of the node they end, and the key of its parent (p1, p2)."""
    rows = materialize(turns.select(
        "conv_id", "pos", "len", F.floor(F.col("pos") / STRETCH).alias("_slice"),
        F.xxhash64("pos", "h1", "h2").alias("x1"), F.xxhash64("h2", "pos", "h1").alias("x2")))
    running = Window.partitionBy("conv_id", "_slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    long = rows.where(F.col("_slice") > 0).select("conv_id").distinct()
    totals = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "_slice").agg(
        F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    carried = totals.select("conv_id", "_slice", F.bit_xor("t1").over(before).alias("b1"), F.bit_xor("t2").over(before).alias("b2"))
    keyed = rows.withColumn("k1", F.bit_xor("x1").over(running)).withColumn("k2", F.bit_xor("x2").over(running)).join(
        carried, ["conv_id", "_slice"], "left")
    for i in "12":
        keyed = keyed.withColumn(f"k{i}", F.col(f"k{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))))
        keyed = keyed.withColumn(f"p{i}", F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")))
    return keyed.select("conv_id", (F.col("pos") + 1).alias("depth"), "k1", "k2", "p1", "p2", "len")


def linked(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent`` and ``parent_conv_id``; the root has nulls."""
    children = nodes.where("depth > 0").withColumn("_key", F.struct(F.col("depth") - 1, F.col("p1"), F.col("p2"))).drop("p1", "p2")
    parents = nodes.select(F.struct(*_KEY).alias("_key"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = salted_join(children, parents, "_key").drop("_key")
    return materialize(found.unionByName(nodes.where("depth = 0").drop("p1", "p2"), allowMissingColumns=True))


def tour(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arcs (id, next, ...) of the Euler tour, and ``n_children`` of the nodes that have some.

    Node n is entered by arc 2 n and left by arc 2 n + 1; siblings come in the order of their smallest member.
    """
    siblings = materialize(numbered(nodes.where("parent IS NOT NULL").select("node", "parent", "conv_id"), "parent", ["conv_id"]))
    children = siblings.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    first = siblings.where("pos = 0").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    follows = siblings.select("parent", (F.col("pos") - 1).alias("pos"), F.col("node").alias("sibling"))
    follows = siblings.select("node", "parent", "pos").join(follows, ["parent", "pos"]).select("node", "sibling")
    all_ = nodes.join(first, "node", "left").join(follows, "node", "left")
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    nothing = F.lit(0).cast("long")
    into = F.struct(enter.alias("id"), F.coalesce(F.col("child") * 2, leave).alias("next"), F.col("depth").alias("along"),
                    F.col("child").isNull().cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved"))
    out = F.struct(leave.alias("id"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"),
                   (-F.col("depth")).alias("along"), nothing.alias("leaves"), nothing.alias("saved"))
    arcs = all_.select("conv_id", F.floor(F.col("depth") / STRETCH).alias("_slice"), F.explode(F.array(into, out)).alias("a"))
    return arcs.select("conv_id", "_slice", "a.*"), children


def subtree_sums(arcs: DataFrame) -> DataFrame:
    """``node``, ``n_leaves`` and ``saved_tokens`` of its subtree, the node included."""
    # nodes of one smallest member are a path: down it, then up again
    sums = suffix_sums(arcs, ["conv_id", "_slice"], [F.col("id") % 2, F.col("along")], ["leaves", "saved"])
    entered = F.col("id") % 2 == 0
    node = F.shiftright("id", 1).alias("node")
    return sums.groupBy(node).agg(*[F.sum(F.when(entered, F.col(s)).otherwise(-F.col(s))).alias(name)
                                    for s, name in (("leaves", "n_leaves"), ("saved", "saved_tokens"))])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Key and bounds of every run of rows with equal keys."""
    keys = np.stack([batch.column(i).to_numpy() for i in range(len(_KEY))], axis=1)
    cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)] if len(keys) else []
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(keys[a].tolist()), a, b


def _rows(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    kinds = {**dict.fromkeys(_KEY, pa.int64()), **kinds}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the conv_ids that end at each node, in decimal and in order, comma-joined.

    Ids are sorted and written out over all tasks; what one task does alone for a node is to hash
    the texts of up to a batch of ids each, one after the other.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3).to_pylist()
            yield _rows([(*key, ids[a], ",".join(map(str, ids[a:b]))) for key, a, b in _runs(batch)], first=pa.int64(), ids=pa.string())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out, texts = [], batch.column(4)
            for key, a, b in _runs(batch):
                if key != now:
                    out += [(*now, state.hexdigest())] if now else []
                    now, state = key, None
                for text in texts.slice(a, b - a):
                    if state is None:
                        state = hashlib.sha256()
                    else:
                        state.update(b",")
                    state.update(text.as_buffer())
            yield _rows(out, sha=pa.string())
        yield _rows([(*now, state.hexdigest())] if now else [], sha=pa.string())

    kind = "depth long, k1 long, k2 long"
    ordered = ends.select(*_KEY, "conv_id").repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    texts = ordered.mapInArrow(write, f"{kind}, first long, ids string")
    return texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(digest, f"{kind}, sha string")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256``."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(role_, text_).alias("h1"),
        F.xxhash64(F.lit(1), text_, role_).alias("h2"), F.char_length(text_).cast("long").alias("len"))
    turns = materialize(numbered(turns, "conv_id", ["turn", "h1", "h2"]).drop("turn"))
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h"))
    convs = materialize(convs)
    keyed = materialize(prefix_keys(rebuilt(turns, convs)))

    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        *[zero.alias(c) for c in (*_KEY, "p1", "p2", "len")], "n_convs", "conv_id")
    nodes = keyed.groupBy(*_KEY).agg(
        F.min(F.struct("p1", "p2", "len")).alias("s"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = nodes.select(*_KEY, "s.*", "n_convs", "conv_id").unionByName(root)
    nodes = linked(materialize(nodes.withColumn("node", F.monotonically_increasing_id())))

    arcs, children = tour(nodes)
    last = keyed.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("e")).select("conv_id", "e.*")
    ends = convs.select("conv_id").join(last, "conv_id", "left").fillna(0, _KEY)
    none = hashlib.sha256().hexdigest()
    return nodes.join(children, "node", "left").join(subtree_sums(arcs), "node").join(end_digests(ends), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(none)).alias("ends_sha256"))
