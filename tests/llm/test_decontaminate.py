"""Decontamination against plain window search."""

import hashlib
import random
import re

from conceptmine.llm import decontaminate

SCHEMA = "doc_id long, text string, n_words string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=13):
    out = {}
    for doc, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            runs = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i:i + n]) in runs:
                    hit[i:i + n] = [True] * n
                    found.add("" if item is None else str(item))
        n_hit = sum(hit)
        out[doc] = (len(w), n_hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    n_hit > 0 and 20 * n_hit >= len(w))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "other") for i, t in docs], SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contamination(d, b).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}


def test_equals_plain_search(spark):
    rnd = random.Random(1)
    letters = ["a", "b", "c", "É", "d", "E"]
    items = [(i, " ".join(rnd.choice(letters) for _ in range(n))) for i, n in enumerate([13, 20, 40, 15, 9, 14, 30])]
    items += [(20, items[1][1]), (None, items[2][1]), (21, None), (22, "")]
    docs = []
    for i in range(120):
        parts = [" ".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 60)))]
        if i % 2:
            t = rnd.choice(items)[1] or ""
            cut = t.split()
            a = rnd.randrange(0, max(1, len(cut) // 2))
            parts.insert(rnd.randrange(0, 2), rnd.choice([" ", ", ", "\n"]).join(cut[a:]))
        docs.append((i, " ".join(parts)))
    docs += [(1000, None), (1001, ""), (1002, " ,.; "), (1003, "x " * 5000 + items[2][1].upper())]
    assert run(spark, docs, items) == plain(docs, items)


def test_short_items_and_no_items(spark):
    items = [(1, "one"), (2, "two words"), (3, "q w e r t y")]
    docs = [(1, "One, two; words"), (2, "two  words one"), (3, "q w e r t"), (4, "z q w e r t y z " * 3), (5, None)]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, [(1, None)]) == plain(docs, [])


def test_clean_cuts_hit_spans_only(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = [(1, f"before it. {item}, after"), (2, item), (3, "x " * 2000 + item), (4, None), (5, "")]
    d = spark.createDataFrame([(i, t, len(t or ""), "k") for i, t in docs], "doc_id long, text string, n_chars int, words string")
    out = {r.doc_id: r for r in decontaminate.decontaminate(
        d, spark.createDataFrame([(1, item)], "item_id long, text string"), n_chars="n_chars").collect()}
    assert out[1].text == "before it. , after" and out[1].n_chars == len(out[1].text)
    assert 2 not in out and out[3].text == docs[2][1] and out[4].text is None and out[5].text == ""
    empty = d.where("false")
    assert decontaminate.decontaminate(empty, d.select(d.doc_id.alias("item_id"), "text")).count() == 0


def test_parts_are_judged_together(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([9, 13, 20, 30])))) for i in range(30)]
    items += [(50, items[3][1]), (51, None), (52, " ,. "), (53, ""), (None, items[4][1])]
    docs = []
    for i in range(80):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 300)))
        # hits of two items that overlap, each too short for a verdict alone
        docs.append((i, f"{text} {rnd.choice(items[:30])[1]} {rnd.choice(items[:30])[1]}" if i % 2 else text))
    docs += [(100, None), (101, ""), (102, docs[1][1]), (102, docs[1][1]), (None, docs[3][1])]
    d = spark.createDataFrame([(i, t, len(t or ""), "k", "x") for i, t in docs], "doc_id long, text string, n_chars int, _key string, _begins string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.Items(b, part_bytes=700).parts > 3
    reports = [sorted(map(str, decontaminate.contamination(d, b, part_bytes=n).collect())) for n in (700, 1 << 20)]
    assert reports[0] == reports[1] and len(reports[0]) == len(docs)
    cleaned = [sorted(map(str, decontaminate.decontaminate(d, b, n_chars="n_chars", part_bytes=n).collect())) for n in (700, 1 << 20)]
    assert cleaned[0] == cleaned[1] and cleaned[0] != sorted(map(str, d.collect()))


def test_items_without_words_are_not_gathered(spark):
    b = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " .,;", "é", "7", "a b"])], "item_id long, text string")
    assert sorted(r.item for r in decontaminate.Items(b).rows.collect()) == ["3", "4", "5"]
