"""Weak labels: the label model on made votes, held-out labels, edges."""

import numpy as np

from conceptmine.llm import weak_quality


def test_label_model_finds_accuracies():
    rnd = np.random.default_rng(2)
    n, k = 60_000, 5
    good = rnd.random(n) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7])
    votes = np.where(rnd.random((n, k)) < right, good[:, None], ~good[:, None]) * 2
    votes[rnd.random((n, k)) < 0.2] = weak_quality.NONE
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    m = weak_quality.LabelModel(patterns, count.astype(float), np.zeros(k, int))
    assert abs(m.share[1] - 0.8) < 0.02
    for j in range(k):
        for c, v in ((1, weak_quality.GOOD), (0, weak_quality.BAD)):
            assert abs(m.chance[c, j, v] / (m.chance[c, j, 0] + m.chance[c, j, 2]) - right[j]) < 0.04


def test_agrees_with_labels_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = weak_quality.score(docs, weak_quality.fit(docs)).join(labels, "doc_id").select("kept", "quality").collect()
    kept = [r.kept for r in rows if r.quality]
    dropped = [not r.kept for r in rows if not r.quality]
    assert sum(kept) / len(kept) > 0.99
    assert sum(dropped) / len(dropped) > 0.9


def test_edges(spark):
    text = "Some words of prose that say this and that, one after another, number {} of many."
    docs = spark.createDataFrame(
        [(i, text.format(i) if i % 4 else "BUY!! NOW!! " * 30, 1) for i in range(80)]
        + [(100, None, 1), (101, "", 1), (102, " \n", 1), (3, "prose of another kind, with several plain words in it", 1),
           (104, "spam " * 40000, 1)], "doc_id long, text string, score int")
    rows = weak_quality.score(docs, weak_quality.fit(docs)).collect()
    wrong = [r for r in rows if r.doc_id < 104 and r.kept != (r.doc_id % 4 != 0 and r.doc_id < 100)]
    assert len(rows) == 85 and wrong == []
    none = docs.where("false")
    assert weak_quality.score(none, weak_quality.fit(none)).count() == 0
    assert not any(r.kept for r in weak_quality.score(docs.where("text IS NULL"), weak_quality.fit(docs.where("text IS NULL"))).collect())


def plain_posteriors(patterns, count, rounds):
    """Expectation-maximisation of one kind of bad text and good text, in loops; no vote says nothing."""
    n, k = len(patterns), len(patterns[0])
    against = [sum(v == weak_quality.BAD for v in row) for row in patterns]
    post = []
    for a in against:
        x = a / max(a, 1) * 0.8 + 0.002, 0.2 if a else 1.0
        post.append([v / sum(x) for v in x])
    for _ in range(rounds):
        share = [(sum(post[i][c] * count[i] for i in range(n)) + 0.1) / (sum(count) + 0.2) for c in range(2)]
        chance = {}
        for c in range(2):
            for j in range(k):
                mass = {v: sum(post[i][c] * count[i] for i in range(n) if patterns[i][j] == v) + 0.1 for v in (weak_quality.BAD, weak_quality.GOOD)}
                for v in mass:
                    chance[c, j, v] = mass[v] / sum(mass.values())
        for i in range(n):
            x = []
            for c in range(2):
                x.append(share[c])
                for j in range(k):
                    x[c] *= chance.get((c, j, patterns[i][j]), 1.0)
            post[i] = [v / sum(x) for v in x]
    return [p[1] for p in post]


def test_posteriors_equal_a_plain_em():
    rnd = np.random.default_rng(5)
    k = 4
    good = rnd.random(3000) < 0.7
    votes = np.where(rnd.random((3000, k)) < 0.85, good[:, None], ~good[:, None]) * 2
    votes[rnd.random((3000, k)) < 0.3] = weak_quality.NONE
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    for rounds in (1, 5, 40):
        model = weak_quality.LabelModel(patterns, count.astype(float), np.zeros(k, int), rounds)
        assert np.abs(model.posterior(patterns) - plain_posteriors(patterns.tolist(), count.tolist(), rounds)).max() < 1e-9


def test_copies_of_one_text_change_no_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    from pyspark.sql import functions as F
    # a text that is in the sample (all are), 13 times as often as all others
    first = docs.where(F.length("text").between(50, 300)).orderBy(F.xxhash64("text")).limit(1).crossJoin(spark.range(13_000)).select("doc_id", "text")
    want = {r.doc_id: r.kept for r in weak_quality.score(docs, weak_quality.fit(docs)).collect()}
    got = {r.doc_id: r.kept for r in weak_quality.score(docs, weak_quality.fit(docs.union(first))).collect()}
    assert sum(want[i] != got[i] for i in want) <= len(want) // 100
    assert 0.2 < sum(want.values()) / len(want) < 1
