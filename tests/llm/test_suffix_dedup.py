"""Repeated passages against plain window search."""

import random
import re

from pyspark.sql import functions as F

from conceptmine.llm import suffix_dedup


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, size):
    seen, out = set(), {}
    for i, text in sorted(docs):
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            run = tuple(w[k:k + size])
            if run in seen:
                gone |= set(range(k, k + size))
            seen.add(run)
        if gone:
            out[i] = gone
    return out


def corpus(seed, size):
    rnd = random.Random(seed)
    fresh = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    passages = [fresh(rnd.choice([size - 1, size, size + 1, size + 5, 2 * size, 4 * size])) for _ in range(12)]
    docs = []
    for i in range(150):
        body = fresh(rnd.randrange(0, 2 * size))
        for p in rnd.sample(passages, rnd.choice([0, 0, 1, 2, 3])):
            own = list(p)
            if rnd.random() < 0.4:
                own[rnd.randrange(len(own))] = "Mutant"
            a, b = sorted((rnd.randrange(len(own)), rnd.randrange(len(own) + 1)))
            body += (own if rnd.random() < 0.6 else own[a:b]) + fresh(rnd.randrange(0, 9))
        docs.append((i, rnd.choice([" ", "\n", " \t"]).join(body)))
    docs += [(900 + i, docs[5 * i][1].upper()) for i in range(9)] + [(-3, None), (-2, ""), (-1, "z " * 400), (990, "q z " * 200)]
    rnd.shuffle(docs)
    return docs


def test_equals_plain_search(spark):
    for seed, size in ((1, 51), (2, 20), (3, 5)):
        docs = corpus(seed, size)
        df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, spans string").repartition(7)
        rows = suffix_dedup.repeated_spans(df, min_words=size).collect()
        got = {r.doc_id: {k for s in r.spans for k in range(s.begin, s.end)} for r in rows}
        want = plain(docs, size)
        assert got == want and len(want) > 20
        by_id = dict(docs)
        for r in rows:
            for s in r.spans:
                run = words(by_id[r.doc_id])[s.begin:s.begin + size]
                assert s.first_doc <= r.doc_id
                assert " ".join(run[:1]) in words(by_id[s.first_doc]) or s.end - s.begin > size


def test_hot_run_over_partition_edges(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    docs = [(i, f"a{i} b{i} {passage} c{i} d{i}") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {r.doc_id: [(s.begin, s.end, s.first_doc < r.doc_id) for s in r.spans]
               for r in suffix_dedup.repeated_spans(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {i: [(2, 82, True)] for i in range(1, 500)}


def test_texts_and_edge_cases(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(1, f"first {passage} end", 5), (2, f"Second {passage}\nlast", 6), (3, passage, 7), (4, None, 8), (5, "short", 9),
            (1, f"first {passage} end", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars int")
    out = sorted((r.doc_id, r.text, r.n_chars) for r in suffix_dedup.remove_repeats(df, n_chars="n_chars").where(F.col("text").isNotNull()).collect())
    kept = f"first {passage} end"
    assert out == [(1, kept, 5), (1, kept, 5), (2, "Second \nlast", 12), (5, "short", 9)]
    assert suffix_dedup.remove_repeats(df).where("text IS NULL").count() == 1
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


def test_texts_stay_in_the_jvm_where_nothing_repeats(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(60))) for i in range(4)], "doc_id long, text string")
    cut = suffix_dedup.remove_repeats(docs)
    assert sorted(r.doc_id for r in cut.collect()) == [0, 1, 2, 3]
    # only the rows that are cut go to Python whole
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" in plan
