"""Fingerprints and their components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from conceptmine.llm import simhash


def plain_fingerprint(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, radius):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[root(i)] for i in range(len(fps))]


def corpus(seed):
    rnd = random.Random(seed)
    texts = ["", None, " \n\t ", "One", "one two", "ONE  TWO", "a b c", "É é ß", "x\x0by\x0cz\x85w v", "the same " * 50]
    for _ in range(25):
        base = [f"w{rnd.randrange(200)}" for _ in range(rnd.choice([3, 5, 40, 200]))]
        for _ in range(rnd.choice([1, 2, 5])):
            texts.append(rnd.choice([" ", "\n", " \t "]).join(base))
            base[rnd.randrange(len(base))] = rnd.choice(["X", "Yé"])
    texts += [texts[12]] * 60
    return [(rnd.randrange(-50, 5000), t) for t in texts]


def test_equals_all_pairs(spark):
    for seed, radius in ((1, 2), (2, 0), (3, 5)):
        docs = corpus(seed) + [(None, "a b c"), (7, "a b c"), (7, "other")]
        df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, fp int, key int, shard int")
        got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, radius=radius).collect()), key=str)
        fps = [plain_fingerprint(t) for _, t in docs]
        least = plain_components([i for i, _ in docs], fps, radius)
        assert got == sorted(((i, f"{f:016x}", m) for (i, _), f, m in zip(docs, fps, least)), key=str)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i % 37}é" for i in range(3000)) + "   end"
    want = simhash.fingerprint(text.encode())
    assert want == plain_fingerprint(text)
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(simhash, "TEXT_BYTES", size)
        assert simhash.fingerprint(text.encode()) == want


def numbers(seed, n):
    """Random numbers, and clouds of them around few centres, most in the lowest bits."""
    rnd = random.Random(seed)
    out = {rnd.getrandbits(64) for _ in range(n // 2)}
    centres = [rnd.getrandbits(64) for _ in range(4)]
    while len(out) < n:
        c = rnd.choice(centres)
        for _ in range(rnd.randrange(7)):
            c ^= 1 << rnd.choice([rnd.randrange(64), rnd.randrange(12)])
        out.add(c)
    return sorted(out)


def test_tree_finds_all_near_numbers():
    keys = np.array(numbers(4, 900), np.uint64)
    tree = simhash.BKTree(keys)
    assert len(tree.children) == len(keys) - 1
    for radius in (0, 2, 6):
        found = {(i, j) for a, b in tree.near(keys[::3], radius) for i, j in zip(a.tolist(), b.tolist())}
        away = np.bitwise_count(keys[::3][:, None] ^ keys[None])
        assert found == set(zip(*[x.tolist() for x in np.nonzero(away <= radius)]))
    assert not list(simhash.BKTree(keys[:0]).near(keys, 2))


@pytest.mark.parametrize("shard", [8192, 40, 5])
def test_crowded_blocks_are_cut_again_without_loss(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    keys = numbers(5, 400 if shard > 5 else 120)
    df = spark.createDataFrame([(simhash._signed(k),) for k in keys], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.near_links(df, 2).collect()]
    assert all(a in keys and b in keys for a, b in links)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    got = {}
    for k in keys:
        got.setdefault(root(k), set()).add(k)
    want = {}
    for k, m in zip(keys, plain_components(keys, keys, 2)):
        want.setdefault(m, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert max(map(len, want.values())) > len(keys) // 20


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
