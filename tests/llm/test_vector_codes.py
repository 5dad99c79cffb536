"""Vector codes against a plain loop over all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from conceptmine.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _vec int, _same string, n int"


def plain(rows, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, i or 0, rows_v, v) for (i, v, _), rows_v in zip(
        kept, [r[1] for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]))
    w = len(order[0][3]) // 16
    books = [[o[3][p * w:p * w + w] for o in order[:entries]] for p in range(16)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p in range(16):
            sums, n = [[0] * w for _ in books[p]], [0] * len(books[p])
            for _, v, _ in kept:
                x = v[p * w:p * w + w]
                _, i = best(x, books[p])
                n[i] += 1
                sums[i] = [a + b for a, b in zip(sums[i], x)]
            books[p] = [[s // n[i] for s in sums[i]] if n[i] else c for i, c in enumerate(books[p])]
    out, by_label = [], {}
    for i, v, lab in kept:
        found = [best(v[p * w:p * w + w], books[p]) for p in range(16)]
        error = sum(d for d, _ in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, e, by_label[lab], sha) for i, code, e, lab in out), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, "y", 2) for i, v, lab in rows], SCHEMA)


def got(df):
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()], key=str)


def made(seed, n, dim):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.3) for _ in range(dim)] for _ in range(7)]
    rows = [(3 * i - 40, [float(np.float32(c + rnd.gauss(0, 0.05))) for c in rnd.choice(centres)], rnd.choice([1, 2, None]))
            for i in range(n)]
    return rows + [(7001 + i, rows[0][1], 1) for i in range(n // 3)]  # a third is one vector


def test_equals_the_plain_loop(spark):
    for seed, n, dim in ((1, 150, 32), (2, 20, 64), (3, 90, 16)):
        rows = made(seed, n, dim)
        bad = [(1, None, 1), (2, [None] + [0.5] * (dim - 1), 1), (4, [float("nan")] * dim, 2), (5, [float("inf")] + [0.0] * (dim - 1), 2)]
        random.Random(seed).shuffle(rows)
        assert got(vector_codes.compress(table(spark, rows + bad))) == plain(rows + bad)


def test_ties_repeats_and_null_ids(spark):
    grid = [[x / 256 for x in ([a] * 8 + [b] * 8)] for a in (0, 2, 4) for b in (0, 2)]
    rows = [(i // 2, v, None) for i, v in enumerate(grid)] * 2 + [(None, [1 / 256] * 16, 3), (0, [3 / 256] * 16, 3)]
    assert got(vector_codes.compress(table(spark, rows), entries=4)) == plain(rows, entries=4)


def test_search_equals_all_distances():
    rng = np.random.default_rng(5)
    for width, m in ((1, 5), (4, 64), (7, 200)):
        x, entries = rng.integers(-6, 6, (500, width)), rng.integers(-6, 6, (m, width))
        full = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        at, best = vector_codes.nearest(x, entries)
        assert (at == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


def test_other_lengths_empty_table_and_limits(spark):
    rows = made(4, 30, 16)
    odd = [(90_000, [], 1), (90_001, [1.0], 2), (-999, [], None)]
    out = {r.vec_id: (r.code, r.error) for r in vector_codes.compress(table(spark, rows + odd)).collect()}
    assert len(out) == len(rows) + 3 and [out[i] for i, _, _ in odd] == [(None, None)] * 3
    want = {i: (code, e) for i, code, e, _, _ in plain(rows)}
    assert {k: v for k, v in out.items() if k in want} == want
    assert vector_codes.compress(table(spark, [])).count() == 0
    assert [(r.code, r.error) for r in vector_codes.compress(table(spark, [(1, [], 1)])).collect()] == [(None, None)]
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0] * 17, 1)]))
    with pytest.raises(Exception, match="64 bits"):
        vector_codes.compress(table(spark, [(1, [1e30] * 16, 1)])).collect()
