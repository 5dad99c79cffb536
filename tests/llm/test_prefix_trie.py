"""The trie against prefixes kept as tuples, and list sums against a walk."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conceptmine.llm import list_rank, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node int, h1 string, pos int, _part int"


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), (r or "", x or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in convs.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {p: 0 for p in members}
    leaves, saved = dict(children), dict(children)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if seqs[c] == p).encode()).hexdigest())
                   for p, m in members.items()), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=str)


def made(seed, n, turns=8):
    """Conversations of few different turns, so that many prefixes are shared; in any order of rows."""
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(450), n):
        for t in range(rnd.randrange(1, turns)):
            rows.append((c, t * 2, rnd.choice(["user", None, ""]), rnd.choice(["a", "é" * 7, None, "😀b"][:1 + rnd.randrange(4)])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("stretch", [4096, 3])
def test_equals_plain_prefixes(spark, monkeypatch, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    for seed, n in ((1, 150), (2, 12)):
        rows = made(seed, n)
        assert got(spark, rows) == plain(rows)


def test_one_long_conversation_and_copies_of_it(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 16)
    long = [(0, t, "user", f"turn {t % 5}") for t in range(200)]
    # other ids of the block, whose rebuilt turns leave the long one at several places
    rows = long + [(c, t, "user", f"turn {t % 5}" if t < 3 * c else f"other {c}") for c in (7, 20, 44, 250) for t in range(150)]
    rows += [(300 + c, 0, "bot", "hello") for c in range(60)]
    assert got(spark, rows) == plain(rows)


def test_nulls_repeats_and_turnless_conversations(spark):
    rows = [(5, None, "user", "x"), (5, 1, None, None), (5, 1, None, None), (5, 2, "", ""), (None, 1, "user", "y"), (-3, 0, "a", "b")]
    rows += [(c, 0, "user", "one turn only") for c in range(101, 131)]  # without a first conversation of the block
    want = plain(rows)
    assert got(spark, rows) == want
    assert want[0][3] > 1 and any(r[1] == 0 and r[7] != hashlib.sha256().hexdigest() for r in want)
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []


def test_sums_of_lists_in_any_blocks(spark):
    rnd = random.Random(3)
    ids = list(range(500))
    rnd.shuffle(ids)
    ends = {ids[-1], ids[99], ids[300]}
    rows = [(i, None if i in ends else n, rnd.randrange(9)) for i, n in zip(ids, ids[1:] + [None])]
    rows += [(1000, None, 4)]
    want, total = {1000: 4}, 0
    for i, n, w in reversed(rows[:-1]):
        total = w + (0 if n is None else total)
        want[i] = total
    df = spark.createDataFrame(rows, "id long, next long, w long")
    for block in (F.lit(0), F.col("id") % 7, F.col("id")):
        out = list_rank.suffix_sums(df.withColumn("b", block), ["b"], [F.col("id")], ["w"])
        assert {r.id: r.w for r in out.collect()} == want
