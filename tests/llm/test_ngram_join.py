"""N-gram join against all pairs."""

import random
import re

from conceptmine.llm import keyset, ngram_join
from conceptmine.llm.components import components


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain(docs, num=90, den=100):
    s = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            k = len(s[i] & s[j])
            if k and den * k >= num * len(s[i] | s[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def corpus(seed, n_base=25):
    rnd = random.Random(seed)
    docs, shared = [], [f"s{i}" for i in range(30)]
    for _ in range(n_base):
        base = [f"w{rnd.randrange(300)}" for _ in range(rnd.choice([1, 2, 3, 10, 22, 60, 150, 300]))]
        if rnd.random() < 0.5:
            base = shared + base
        for _ in range(rnd.choice([1, 1, 2, 6, 14])):
            docs.append(" ".join(base))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                base[rnd.randrange(len(base))] = rnd.choice(["X", "Yé", "z"])
            if rnd.random() < 0.3:
                base = base + ["tail"] * rnd.randrange(3)
    docs += ["", "  \n", "One two", "one TWO", "one", "z " * 4000]
    rnd.shuffle(docs)
    return [(1000 - 3 * i, t) for i, t in enumerate(docs)] + [(5000, None), (5001, None)]


def test_equals_all_pairs(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, size int")
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect())
        want = plain(docs)
        assert got == want
        assert len({x[2] for x in want}) < len(docs) - 20


def test_number_of_links_equals_all_pairs(spark, monkeypatch):
    for block in (ngram_join.BLOCK, 4):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        base = [f"w{k}" for k in range(200)]
        docs = corpus(3, 12) + [(9000 + i, " ".join(base[:i * 5] + [f"x{i}"] + base[i * 5 + 1:])) for i in range(30)]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        kinds = {i: frozenset(shingles(t)) for i, t in docs}
        other = set(kinds.values())
        want = {i: sum(100 * len(s & o) >= 90 * len(s | o) for o in other if s and o != s) for i, s in kinds.items()}
        assert {r.doc_id: r.n_links for r in ngram_join.similar_groups(df).collect()} == want
        assert max(want.values()) >= 29


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "other words here now"), (2, "A b  c d")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert ngram_join.similar_groups(df.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (205, 201), (201, 209)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}, 201: 201, 205: 201, 209: 201}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_set_has_all_keys(spark):
    import numpy as np
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 5000)
    some = keyset.key_set(spark.createDataFrame([(int(k),) for k in keys[:2500]], "k long"), "k")
    assert some.maybe(keys[:2500]).all() and some.maybe(keys[2500:]).mean() < 0.2


def test_hubs_are_dealt_to_slices(spark, monkeypatch):
    import random

    from conceptmine.llm import components as module
    rnd = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(900, 500 + i) for i in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5, 5), (3, 0), (3, 0)]
    rnd.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 7), (7, None), (None, None)], "a long, b long")
    for hubs in (True, False):
        got = {r.node: r.label for r in components(df, hubs).collect()}
        assert got == {i: 0 if i < 400 else 500 if i < 950 else 1000 for i in {x for e in edges for x in e}}
    rows = module.materialize(spark.createDataFrame([(u, v) for u, v in edges], "u long, v long"))
    joined, least = module._with_least(rows)
    want = {}
    for u, v in edges:
        want[u] = min(v, want.get(u, v))
    assert {r.u: r.m for r in least.collect()} == want
    assert sorted((r.u, r.v, r.m) for r in joined.collect()) == sorted((u, v, want[u]) for u, v in edges)
