"""SimHash fingerprints and their near pairs by BK-trees.

A text's word shingles are hashed; a fingerprint bit is set if over half of the hashes have
it. Texts link if their fingerprints differ in at most ``radius`` bits.

Equal fingerprints are one row from the start. The distinct ones are dealt to shards: cut
the 64 bits into radius + 1 blocks; fingerprints within the radius agree on one block at
least, so each goes to the shard of each of its blocks. Where too many share a block, the
rest of their bits is cut again in the same way, until no group is large; as bits run out, groups do
too, so nothing is left over. A shard holds many such groups, about ``SHARD`` fingerprints.

Every shard has a BK-tree: a child is keyed by its Hamming distance to its parent, and a
search follows only the edges within the radius of a query's own distance. A tree goes to the
tasks that hold its shard's queries, not to all: all trees together grow with the corpus. A task
returns the links that tie its fingerprints together, one for each at most, never its pairs.

Defined results: a text without words, or null, has fingerprint zero, which links like any
other; rows with the same id take part one by one; a null id is larger than others; an empty
table gives no rows; further columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.llm.components import components
from conceptmine.operators.skew import salted_join
from conceptmine.session import materialize

SEED = 42
#: Fingerprints of a shard, about; a group of more that share their fixed bits is cut again.
SHARD = 8192
#: Queries that look through a tree at once, and bytes of a text that are cut into words at once.
QUERIES, TEXT_BYTES = 256, 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece, so that a long text never stands as one list."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, min(at + TEXT_BYTES, len(text)))
        end = cut.start() if cut else len(text)
        yield text[at:end].split()  # the white space of bytes is \x20 and \x09-\x0D
        at = end


def _bits(shingles: list[bytes]) -> np.ndarray:
    """How many hashes of the shingles have each of the 64 bits, the highest first."""
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles))
    return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _runs(words: list[bytes], n: int) -> list[bytes]:
    text, end = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    start = np.r_[0, end[:-1]][:len(words) - n + 1]
    return [text[a:b] for a, b in zip(start.tolist(), (end[n - 1:] - 1).tolist())]


def fingerprint(text: bytes, n: int = 3) -> int:
    """64-bit fingerprint of a text by its runs of n words, repeats included."""
    counts, number, before = np.zeros(64, np.int64), 0, []
    for words in _pieces(text.lower()):  # bytes.lower changes A-Z alone
        words = before + words
        if len(words) >= n:
            counts += _bits(_runs(words, n))
            number += len(words) - n + 1
        before = words[max(0, len(words) - n + 1):]
    if not number and before:
        counts, number = _bits([b" ".join(before)]), 1
    return int.from_bytes(np.packbits(2 * counts > number).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number, of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), n) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """A BK-tree of distinct 64-bit numbers in arrays, built and searched level by level."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        slots, children = [], []
        rest, parent = np.arange(1, len(keys)), np.zeros(max(len(keys) - 1, 0), np.int64)
        while len(rest):
            slot = parent * 65 + np.bitwise_count(keys[rest] ^ keys[parent])
            # the first to come to a slot is the child there, the others go below it
            slot_of, first, which = np.unique(slot, return_index=True, return_inverse=True)
            slots.append(slot_of)
            children.append(rest[first])
            below = np.ones(len(rest), bool)
            below[first] = False
            rest, parent = rest[below], rest[first][which[below]]
        slots, children = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (slots, children))
        order = np.argsort(slots)
        #: edges by (parent, distance) as parent * 65 + distance, and the child at their end
        self.edges, self.children = slots[order], children[order]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, key) of numbers at most ``radius`` bits apart, by their positions."""
        for begin in range(0, len(queries) if len(self.keys) else 0, QUERIES):
            q = np.arange(begin, min(begin + QUERIES, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                away = np.bitwise_count(queries[q] ^ self.keys[node]).astype(np.int64)
                hit = away <= radius
                yield q[hit], node[hit]
                low = np.searchsorted(self.edges, node * 65 + np.maximum(away - radius, 0))
                many = np.searchsorted(self.edges, node * 65 + np.minimum(away + radius, 64), "right") - low
                q = np.repeat(q, many)
                node = self.children[np.repeat(low - np.cumsum(many) + many, many) + np.arange(len(q))]


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Tie the trees of a and b together in ``parent``, whose roots are the smallest of their tree."""
    while len(a):
        while (parent[a] != a).any() or (parent[b] != b).any():
            a, b = parent[a], parent[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(parent, a, b)


def _blocks(fixed: int, radius: int) -> list[int]:
    """``fixed`` with each of radius + 1 blocks of the other bits fixed as well."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [fixed | sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(numbers: DataFrame, radius: int) -> DataFrame:
    """``fp`` and ``shard``: distinct numbers at most ``radius`` bits apart meet in a shard."""
    full, masks, done = (1 << 64) - 1, [0], None
    open_ = numbers.select("fp", F.lit(0).cast("long").alias("fixed"))
    while masks:
        step = F.create_map(*[x for m in masks for x in (
            F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(b)).cast("long") for b in _blocks(m, radius)]))])
        rows = open_.select("fp", F.explode(step[F.col("fixed")]).alias("fixed"))
        rows = materialize(rows.withColumn("key", F.xxhash64("fixed", F.col("fp").bitwiseAND(F.col("fixed")))))
        large = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("key"))
        settled = rows.join(large, "key", "left_anti").select("fp", "key")
        done = settled if done is None else done.union(settled)
        # the same bits may have been fixed in another order
        open_ = rows.join(large, "key", "left_semi").select("fp", "fixed").distinct()
        # at most (radius + 1) ** rounds; with every bit fixed a group is one number
        masks = [m for r in open_.select("fixed").distinct().collect() if (m := r.fixed % (1 << 64)) != full]
        open_ = open_.where(F.col("fixed").isin([_signed(m) for m in masks]))
    done = materialize(done)
    many = -(-done.count() // SHARD)
    return done.select("fp", F.pmod("key", F.lit(max(1, many))).alias("shard"))


def near_links(numbers: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that tie together all distinct numbers ``fp`` reachable by steps of at most ``radius`` bits."""
    def tie(table: pa.Table) -> pa.Table:
        # a number comes once for each of its blocks
        keys = np.unique(table.column("fp").to_numpy().view(np.uint64))
        parent = np.arange(len(keys))
        for a, b in BKTree(keys).near(keys, radius):
            _joined(parent, a, b)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        tied = np.flatnonzero(parent != np.arange(len(keys)))
        return pa.table({"a": keys[tied].view(np.int64), "b": keys[parent[tied]].view(np.int64)})

    return shards(numbers, radius).groupBy("shard").applyInArrow(tie, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable by links) of every row."""
    if not 0 <= radius < 64:
        raise ValueError("the radius must be 0 to 63 bits")
    rows = materialize(fingerprints(docs, doc_id, text, n))
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(near_links(classes, radius), hubs=True).toDF("fp", "label")
    named = classes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = salted_join(materialize(named), smallest, "label").select("fp", "component_id")
    return salted_join(rows, named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
