"""Concept to pattern: the knowledge base as a keyed table and its tiered lookup."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.operators.skew import salted_join
from conceptmine.session import materialize

#: Characters of all keys and patterns that are broadcast, some 120 bytes each in a task.
MAX_KEY_CHARS = 500_000


def pattern_map(kb: DataFrame) -> DataFrame:
    """``(file_no, ord, name, pattern)`` to one row per name.

    The last row of a name gives its pattern, its first row gives its place ``pos``.
    """
    order = F.struct("file_no", "ord")
    usable = kb.where((F.col("name") != "") & (F.col("pattern") != ""))
    return usable.groupBy("name").agg(
        F.max_by("pattern", order).alias("pattern"), F.min(order).alias("pos"))


class KeyTrie:
    """The three tiers of a key table in one look at a name.

    Keys stand in a trie from their ends, so a name is followed from its last character until no key goes on.
    """

    def __init__(self, names: list[str], patterns: list[str], shorts: list[str]):
        """Keys in map order."""
        self.full = dict(zip(names, patterns))
        self.short = dict(zip(shorts, patterns))  # the last one of a short name wins
        self.patterns = patterns
        self.edges: dict[tuple[int, str], int] = {}
        self.ends: dict[int, int] = {}
        for place, name in enumerate(names):
            node = 0
            for char in reversed(name):
                node = self.edges.setdefault((node, char), len(self.edges) + 1)
            self.ends.setdefault(node, place)

    def suffix(self, name: str) -> str | None:
        """Pattern of the first key in map order that ends the name."""
        node, best = 0, len(self.patterns)
        for char in reversed(name):
            node = self.edges.get((node, char))
            if node is None:
                break
            best = min(best, self.ends.get(node, best))
        return self.patterns[best] if best < len(self.patterns) else None

    def look(self, name: str | None, short: str | None) -> dict | None:
        if name is None:
            return None
        for tier, found in (("full", self.full.get(name)), ("short", self.short.get(short))):
            if found is not None:
                return {"pattern": found, "tier": tier}
        found = self.suffix(name)
        return {"pattern": found, "tier": "none" if found is None else "suffix"}


def _with_trie(concepts: DataFrame, kb_map: DataFrame) -> DataFrame:
    keys = kb_map.select("name", "pattern", tx.short_name(F.col("name")).alias("short"), "pos").orderBy("pos").toArrow()
    shared = concepts.sparkSession.sparkContext.broadcast(
        KeyTrie(*(keys[c].to_pylist() for c in ("name", "pattern", "short"))))
    kind = pa.struct([("pattern", pa.string()), ("tier", pa.string())])

    @F.arrow_udf("pattern string, tier string")
    def look(names: pa.Array, shorts: pa.Array) -> pa.Array:
        trie = shared.value
        return pa.array([trie.look(n, s) for n, s in zip(names.to_pylist(), shorts.to_pylist())], kind)

    found = concepts.withColumn("_found", look(F.col("name"), F.col("short_name")))
    return found.withColumns({
        "pattern": F.nullif(F.col("_found.pattern"), F.lit("N/A")), "tier": F.col("_found.tier")}).drop("_found")


def _with_joins(concepts: DataFrame, kb_map: DataFrame) -> DataFrame:
    names = concepts.select("name", "short_name").distinct()
    by_full = kb_map.select("name", F.col("pattern").alias("full_pattern"))
    by_short = kb_map.groupBy(tx.short_name(F.col("name")).alias("short_name")).agg(
        F.max_by("pattern", "pos").alias("short_pattern"))
    known = materialize(names.join(by_full, "name", "left").join(by_short, "short_name", "left"))

    # endings of the lengths that keys have, of which there are no more than the longest key has characters
    lengths = sorted(r.n for r in kb_map.select(F.length("name").alias("n")).distinct().collect())
    have = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("name"))
    open_names = known.where(F.col("full_pattern").isNull() & F.col("short_pattern").isNull())
    endings = materialize(open_names.select("name", F.explode(F.transform(have, lambda n: F.right("name", n))).alias("key")))
    # very many names may end in one character
    keys = kb_map.select(F.col("name").alias("key"), "pattern", "pos")
    by_suffix = salted_join(endings, keys, "key").groupBy("name").agg(F.min_by("pattern", "pos").alias("suffix_pattern"))
    resolved = known.join(by_suffix, "name", "left").select(
        "name",
        F.nullif(F.coalesce("full_pattern", "short_pattern", "suffix_pattern"), F.lit("N/A")).alias("pattern"),
        F.when(F.col("full_pattern").isNotNull(), "full")
        .when(F.col("short_pattern").isNotNull(), "short")
        .when(F.col("suffix_pattern").isNotNull(), "suffix")
        .otherwise("none").alias("tier"),
    )
    return concepts.join(resolved, "name", "left")


def resolve_patterns(concepts: DataFrame, kb_map: DataFrame, max_key_chars: int = MAX_KEY_CHARS) -> DataFrame:
    """Adds ``short_name``, ``pattern`` (null when unresolved) and ``tier`` to every concept.

    Tiers: the full name is a key; else the short name equals a key's short
    name; else the first key, in map order, that ends the name. A key whose pattern is
    'N/A' ends the search but resolves nothing. A null name has no tier.

    Keys of at most ``max_key_chars`` characters (checked) are broadcast as a trie and concepts
    are looked up where they are. More keys are joined; both ways give the same rows.
    """
    concepts = concepts.withColumn("short_name", tx.short_name(F.col("name"))).drop("pattern")
    kb_map = materialize(kb_map)
    chars = kb_map.agg(F.sum(F.length("name") + F.length("pattern"))).first()[0]
    if chars is None:
        return concepts.withColumns({"pattern": F.lit(None).cast("string"), "tier": F.when(F.col("name").isNotNull(), "none")})
    return _with_trie(concepts, kb_map) if chars <= max_key_chars else _with_joins(concepts, kb_map)


def unclassified(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("pattern").isNull()).select("name", "summary")


def mapping_summary(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count("pattern").alias("resolved"), F.count("*").alias("total"))


def consolidate(kb: DataFrame) -> DataFrame:
    """All knowledge-base rows with their framework first."""
    return kb.select("framework", *[c for c in kb.columns if c not in ("framework", "file_no", "ord")])
