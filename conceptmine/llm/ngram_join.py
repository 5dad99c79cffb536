"""Exact Jaccard self-join on word n-grams with prefix, length, positional and suffix filters.

* Texts with equal n-gram sets are one class; everything below works on classes.
* The n-grams of a class are ordered rare first, by counts over all documents. Two
  classes can only be similar if they share one of their first n-grams (prefix).
* Round one compares every class with one leader of each of its prefix n-grams; the
  links found merge classes. Round two compares the classes that share a prefix n-gram
  and are still in different components. No link between components is lost.
* Every link is inside a component, so links are counted there: the classes of a component
  are dealt to blocks of bounded size, blocks of fitting set sizes meet two by two, and a
  task returns the number of links of each class, never the pairs. The work is still that
  of all pairs of a component.
* Candidates meet the length and positional filters in the join and the suffix filter
  (counts by range of hash) before any text moves. Each pair left is verified once.

Defined results: a text without words, or null, has an empty set, links with nothing and
is its own component; rows with the same id take part one by one; an empty table gives
no rows; further columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.llm import vec
from conceptmine.llm.components import components
from conceptmine.llm.keyset import key_set
from conceptmine.llm.rows import small_batches, written
from conceptmine.session import materialize

#: Counters of the n-gram frequencies, a bound on what is broadcast. Any fixed order gives the same links.
COUNTERS = 1 << 18
#: Hash ranges of the suffix filter.
RANGES = 128
#: Classes, and n-grams of all their sets, of a block in which links are counted, about.
BLOCK, BLOCK_GRAMS = 128, 1 << 19


class Similarity:
    """Jaccard of at least num / den, in whole numbers."""

    def __init__(self, n: int, num: int, den: int):
        self.n, self.num, self.den = n, num, den

    def prefix(self, size: int) -> int:
        """Prefix of the larger set of a pair."""
        return size + (-size * self.num) // self.den + 1

    def index_prefix(self, size: int) -> int:
        """Prefix of the smaller set of a pair."""
        return size + (-size * 2 * self.num) // (self.num + self.den) + 1

    def overlap(self, both):
        """Least common n-grams of two sets with ``both`` n-grams together."""
        return -((-both * self.num) // (self.num + self.den))


def sets(buf: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text; a text of fewer words is one n-gram."""
    starts, ends, first = vec.spans(buf, offsets, vec.NOT_SPACE)
    words = vec.hashes(buf, starts, ends)
    whole = vec.grams(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(whole[a:b - n + 1]))
        elif b > a:
            out.append(vec.scramble(vec.grams(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How often n-grams occur, over all documents, by the last bits of their hash."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, buf, offsets in vec.slices(batch, "_text"):
                starts, ends, first = vec.spans(buf, offsets, vec.NOT_SPACE)
                at = vec.gram_starts(first, n)
                if len(at):
                    g = vec.grams(vec.hashes(buf, starts, ends), n)[at]
                    total += np.bincount((g & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        some = np.flatnonzero(total)
        for i in range(0, len(some), 1 << 16):
            k = some[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["k", "c"])

    with small_batches(docs.sparkSession):
        sums = docs.select("_text").mapInArrow(count, "k int, c long").groupBy("k").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[sums.k.to_numpy()] = sums.c.to_numpy()
    return out


def signatures(docs: DataFrame, sim: Similarity) -> DataFrame:
    """Per row: set size, a 128-bit digest of the set, the prefix rare first, counts by hash range."""
    counts = docs.sparkSession.sparkContext.broadcast(gram_counts(docs, sim.n))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for batch in batches:
            for part, buf, offsets in vec.slices(batch, "_text"):
                size, d1, d2, prefix, ranges = [], [], [], [], []
                for s in sets(buf, offsets, sim.n):
                    k = len(s)
                    size.append(k)
                    d1.append(int(vec.scramble(s).sum(dtype=np.uint64).astype(np.int64)))
                    d2.append(int(vec.scramble(s * np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)))
                    order = np.argsort(often[(s & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                    prefix.append(s[order[:sim.prefix(k)]].view(np.int64) if k else s.view(np.int64))
                    ranges.append(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=RANGES).astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    pa.array(prefix, pa.list_(pa.int64())), pa.array(ranges, pa.binary())],
                    ["doc_id", "text_hash", "size", "d1", "d2", "prefix", "ranges"])

    rows = docs.select("doc_id", F.xxhash64("_text").alias("text_hash"), "_text")
    return written(rows.mapInArrow(
        run, f"doc_id {kind}, text_hash long, size long, d1 long, d2 long, prefix array<long>, ranges binary"))


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct set with a number of its own; the smallest document stands for it."""
    digest = ["d1", "d2", "size"]
    least = rows.where("size > 0").groupBy(*digest).agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    full = least.select(*digest, "r.*").alias("l").join(
        rows.select("doc_id", "text_hash", "prefix", "ranges", "d1", "d2").alias("f"),
        (F.col("l.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("l.text_hash") == F.col("f.text_hash"))
        & (F.col("l.d1") == F.col("f.d1")) & (F.col("l.d2") == F.col("f.d2")))
    one = full.groupBy(*[F.col(f"l.{c}") for c in digest]).agg(
        F.first("l.doc_id").alias("doc_id"), F.first("l.text_hash").alias("text_hash"),
        F.first("f.prefix").alias("prefix"), F.first("f.ranges").alias("ranges"))
    return materialize(one.withColumn("node", F.monotonically_increasing_id()))


def postings(nodes: DataFrame, sim: Similarity) -> DataFrame:
    """Prefix n-grams that more than one class has, with the class, its size, band and place in the prefix."""
    grams = nodes.select(F.explode("prefix").alias("gram"))
    shared = materialize(grams.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram"))
    some = nodes.sparkSession.sparkContext.broadcast(key_set(shared, "gram"))
    width = math.log(sim.den / sim.num) * 1.0001

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy()
            size = np.diff(np.r_[0, np.cumsum(lists.value_lengths().to_numpy())])
            owner = np.repeat(np.arange(batch.num_rows), size)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            keep = np.flatnonzero(some.value.maybe(flat))
            n = batch.column(1).to_numpy()[owner[keep]]
            yield pa.RecordBatch.from_arrays([
                pa.array(flat[keep]), pa.array(batch.column(0).to_numpy()[owner[keep]]), pa.array(n),
                pa.array(place[keep].astype(np.int32)), pa.array(np.floor(np.log(n) / width).astype(np.int32)),
                pa.array(place[keep] < n + (-n * 2 * sim.num) // (sim.num + sim.den) + 1)],
                ["gram", "node", "size", "place", "band", "indexed"])

    rows = nodes.select("node", "size", "prefix").mapInArrow(
        run, "gram long, node long, size long, place int, band int, indexed boolean")
    return written(rows.join(shared, "gram"))


def _need(both, sim: Similarity):
    """Least common n-grams of a pair with so many n-grams, at most one too low for rounding."""
    return F.ceil(both * sim.num / F.lit(sim.num + sim.den) - 1e-6)


def _possible(x: str, y: str, sim: Similarity):
    """Length and positional filters for x at least as large as y."""
    size, least = F.col(f"{x}.size"), F.col(f"{y}.size")
    room = F.least(size - F.col(f"{x}.place"), least - F.col(f"{y}.place"))
    return (least * sim.den >= size * sim.num) & (room >= _need(size + least, sim))


def leader_pairs(posts: DataFrame, sim: Similarity) -> DataFrame:
    """Every class with the leader of its prefix n-gram and band: the class that has the fewest rarer n-grams.

    In a group of altered copies that is the one with the fewest alterations, which most others resemble.
    """
    lead = posts.groupBy("gram", "band").agg(F.min(F.struct("place", "size", "node")).alias("l")).select("gram", "band", "l.*")
    x, y = posts.alias("x"), lead.alias("y")
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    room = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    fits = (small * sim.den >= large * sim.num) & (room >= _need(small + large, sim))
    return x.join(y, ["gram", "band"]).where((F.col("x.node") != F.col("y.node")) & fits).select(
        F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def other_pairs(posts: DataFrame, labels: DataFrame, done: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs that share a prefix n-gram and are in different components, without those compared before."""
    label = F.coalesce("label", F.col("node"))
    named = posts.join(labels, "node", "left").withColumn("label", label)
    mixed = named.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gram")
    open_ = materialize(named.join(mixed, "gram"))
    y = open_.where("indexed").withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    x, y = open_.alias("x"), y.alias("y")
    larger = (F.col("x.size") > F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.node") > F.col("y.node")))
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.band") == F.col("y.band"))
                   & (F.col("x.label") != F.col("y.label")) & larger & _possible("x", "y", sim))
    pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def suffix_filter(pairs: DataFrame, nodes: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs whose sets can still have enough in common, going by their counts in each range of hashes."""
    have = nodes.select("node", "size", "ranges")
    both = pairs.join(have.toDF("a", "size_a", "ranges_a"), "a").join(have.toDF("b", "size_b", "ranges_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k) for k in batch.schema.names}
            x, y = (np.frombuffer(b"".join(c[k].to_pylist()), np.uint32).reshape(-1, RANGES) for k in ("ranges_a", "ranges_b"))
            most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            keep = most >= sim.overlap(c["size_a"].to_numpy() + c["size_b"].to_numpy())
            yield pa.RecordBatch.from_arrays([c["a"], c["b"]], ["a", "b"]).filter(pa.array(keep))

    return written(both.mapInArrow(run, "a long, b long"))


def class_texts(ids: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node`` and ``_text`` of the given classes. Only their texts move."""
    need = materialize(nodes.join(ids, "node", "left_semi").select(
        "node", F.col("text_hash"), F.col("doc_id").alias("_id")))
    some = docs.sparkSession.sparkContext.broadcast(key_set(need, "text_hash"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(some.value.maybe(batch.column(1).to_numpy())))

    rows = docs.select("doc_id", F.xxhash64("_text").alias("text_hash"), "_text")
    rows = rows.mapInArrow(keep, rows.schema)
    texts = need.alias("n").join(rows.alias("d"), (F.col("n.text_hash") == F.col("d.text_hash"))
                                 & F.col("n._id").eqNullSafe(F.col("d.doc_id"))).select("node", "_text")
    return written(texts.dropDuplicates(["node"]))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs whose sets are similar, by the sets themselves."""
    texts = class_texts(pairs.select("a").union(pairs.select("b")).toDF("node").distinct(), nodes, docs)
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for part, buf, offsets in vec.slices(batch, "text_a"):
                left = sets(buf, offsets, sim.n)
                right = [s for _, b, o in vec.slices(part, "text_b") for s in sets(b, o, sim.n)]
                for x, y in zip(left, right):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(sim.den * common >= sim.num * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return written(both.mapInArrow(run, "a long, b long"))


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common n-grams of every set of x with every set of y."""
    out = np.zeros((len(x), len(y)), np.int64)
    flat = [np.concatenate(s) for s in (x, y)]
    owner = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    both = np.intersect1d(*flat)
    place = [np.searchsorted(both, f) for f in flat]
    found = [both[np.minimum(p, max(len(both) - 1, 0))] == f if len(both) else np.zeros(len(f), bool) for p, f in zip(place, flat)]
    for begin in range(0, len(both), 8192):
        part = []
        for s, p, f, o in zip((x, y), place, found, owner):
            m = np.zeros((len(s), min(8192, len(both) - begin)), np.float32)
            use = f & (p >= begin) & (p < begin + 8192)
            m[o[use], p[use] - begin] = 1
            part.append(m)
        out += (part[0] @ part[1].T).astype(np.int64)
    return out


def link_counts(nodes: DataFrame, labels: DataFrame, docs: DataFrame, sim: Similarity) -> DataFrame:
    """``node`` and ``n_links``: the other classes its set is similar to, for the classes of ``labels``."""
    width = math.log(sim.den / sim.num) * 1.0001 if sim.num < sim.den else 1.0
    named = materialize(nodes.join(labels, "node").select(
        "node", "label", "size", F.floor(F.log("size") / width).cast("int").alias("band")))
    counts = materialize(named.groupBy("label", "band").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks")))
    two = counts.select("label", (F.col("band") - 1).alias("band"), F.col("blocks").alias("next"))
    own = named.join(counts, ["label", "band"]).join(two, ["label", "band"], "left").withColumn(
        "at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    before = counts.select("label", (F.col("band") + 1).alias("band"), F.col("blocks").alias("last"))
    own = own.join(before, ["label", "band"], "left")
    # x is the lower block: of the band itself, then all of the next band's
    inside = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.col("band").alias("x_band"), F.least("at", o).alias("x_at"), F.col("band").alias("y_band"), F.greatest("at", o).alias("y_at")))
    upward = F.transform(F.sequence(F.lit(0), F.col("next") - 1), lambda o: F.struct(
        F.col("band").alias("x_band"), F.col("at").alias("x_at"), (F.col("band") + 1).alias("y_band"), o.alias("y_at")))
    downward = F.transform(F.sequence(F.lit(0), F.col("last") - 1), lambda o: F.struct(
        (F.col("band") - 1).alias("x_band"), o.alias("x_at"), F.col("band").alias("y_band"), F.col("at").alias("y_at")))
    none = F.slice(inside, 1, 0)
    dealt = own.withColumn("p", F.explode(F.concat(inside, F.coalesce(upward, none), F.coalesce(downward, none)))).select(
        "node", "label", "p.*", ((F.col("p.x_band") == F.col("band")) & (F.col("p.x_at") == F.col("at"))).alias("left"))
    texts = class_texts(labels.select("node"), nodes, docs)

    def count(table: pa.Table) -> pa.Table:
        node, left = table.column("node").to_numpy(), table.column("left").to_numpy(zero_copy_only=False)
        given = [s for batch in table.select(["_text"]).combine_chunks().to_batches() for _, b, o in vec.slices(batch, "_text")
                 for s in sets(b, o, sim.n)]
        x = [i for i in range(len(node)) if left[i]]
        y = [i for i in range(len(node)) if not left[i]]
        alone = not y
        y = y or x
        if not x:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        common = _common([given[i] for i in x], [given[i] for i in y])
        size = np.array([len(s) for s in given], np.int64)
        good = sim.den * common >= sim.num * (size[x][:, None] + size[y][None, :] - common)
        if alone:
            np.fill_diagonal(good, False)
            return pa.table({"node": node[x], "links": good.sum(axis=1)})
        return pa.table({"node": np.r_[node[x], node[y]], "links": np.r_[good.sum(axis=1), good.sum(axis=0)]})

    found = dealt.join(texts, "node").groupBy("label", "x_band", "x_at", "y_band", "y_at").applyInArrow(count, "node long, links long")
    return materialize(found.groupBy("node").agg(F.sum("links").alias("n_links")))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, num: int = 90,
                   den: int = 100, count_links: bool = True) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``n_links``, for every row.

    Links join texts with Jaccard of at least num / den. ``n_links`` is the number of other classes
    that the row's class is linked to; it is left out if links are not to be counted. ``text_hash`` is
    the xxhash64 of the row's text, and ``kept`` is true for the one smallest (id, text hash) of a group.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity must be over 0 and at most 1")
    sim = Similarity(n, num, den)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    rows = signatures(docs, sim)
    nodes = classes(rows)
    posts = postings(nodes, sim)
    first = suffix_filter(leader_pairs(posts, sim), nodes, sim)
    links = verified(first, nodes, docs, sim)
    labels = materialize(components(links))
    rest = suffix_filter(other_pairs(posts, labels, first, sim), nodes, sim)
    links = links.union(verified(rest, nodes, docs, sim))
    labels = materialize(components(links))
    degree = link_counts(nodes, labels, docs, sim) if count_links else None
    named = nodes.select("node", "d1", "d2", "size", "doc_id", "text_hash").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", F.col("node")))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min(F.struct("doc_id", "text_hash")).alias("least"))
    named = named.join(least, "label")
    if count_links:
        named = named.join(degree, "node", "left")
    named = named.select("d1", "d2", "size", "component_id", "least", *["n_links"] * count_links)
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    return rows.select("doc_id", "text_hash", "d1", "d2", "size").join(named, ["d1", "d2", "size"], "left").select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *[F.coalesce("n_links", F.lit(0)).alias("n_links")] * count_links,
        "text_hash", F.when(F.col("size") > 0, first).otherwise(True).alias("kept"))
