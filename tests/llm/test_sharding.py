"""Placement by the filled table: rules of the table, and rows of every kind."""

import hashlib
from collections import Counter

from conceptmine.llm import sharding

SHARDS = ["a", "b", "c", "d", "e"]


def test_table_is_full_and_even():
    table = sharding.lookup_table(SHARDS)
    count = Counter(table)
    assert len(table) == sharding.TABLE_SIZE and set(count) == set(range(5))
    assert max(count.values()) - min(count.values()) <= 1
    # without one shard most slots of the others stay
    fewer = sharding.lookup_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(table, fewer) if a != 4)
    assert moved < 0.35 * len(table)


def test_nulls_repeats_clashing_names_and_an_empty_table(spark):
    rows = [(7, "x", 1, "k"), (7, "x", 1, "k"), (None, None, None, None), (-3, "y", 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, slot int, text string")
    out = sharding.place(df.select("doc_id"), "doc_id", SHARDS).collect()
    table = sharding.lookup_table(SHARDS)

    def slot(key):
        text = "k" + ("" if key is None else f":{key}")
        return int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE

    assert sorted((str(r.doc_id), r.slot, r.shard) for r in out) == sorted(
        (str(i), slot(i), SHARDS[table[slot(i)]]) for i, *_ in rows)
    assert sharding.place(df.where("false").select("doc_id"), "doc_id", SHARDS).count() == 0
