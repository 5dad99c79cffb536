"""License scan against plain containment in the same windows."""

import random
import re

import pytest

from conceptmine.llm import licenses


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def grams(w):
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def plain(docs, least=0.8):
    out = {}
    for i, text in docs:
        g = grams(words(text))
        for name, t in licenses.TEMPLATES:
            own = set(grams(words(t)))
            for s in range(0, len(g), licenses.STRIDE):
                share = len(own & set(g[s:s + 20])) / len(own)
                if share >= least:
                    best, first, where = out.get((i, name), (0, s, set()))
                    out[i, name] = (max(best, share), min(first, s), where | {s})
    return {k: (round(b, 6), f, len(w)) for k, (b, f, w) in out.items()}


def test_equals_plain_scan(spark):
    rnd = random.Random(3)
    docs = []
    for i in range(150):
        w = [rnd.choice(["license", "licensed", "the", "under", "software", "plain", "été"]) + str(rnd.randrange(3) or "") for _ in range(rnd.randrange(0, 90))]
        if i % 2:
            notice = words(rnd.choice(licenses.TEMPLATES)[1])
            if i % 3 == 0:
                notice[rnd.randrange(len(notice))] = "changed"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = notice
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w).title() if i % 5 else " ".join(w)))
    docs += [(900, None), (901, ""), (902, "MIT License"), (903, "x " * 60000 + "Released under the MIT License."), (7, docs[7][1])]
    df = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): (round(r.containment, 6), r.first_word, r.n_windows) for r in licenses.scan(df).collect()}
    want = plain(docs)
    assert {k for k in got} == {k for k in want} and len(want) > 40
    # a band may miss a window of several, never invent one
    assert all(got[k][2] <= want[k][2] and got[k][1] >= want[k][1] for k in want)
    assert sum(v[2] for v in got.values()) >= 0.97 * sum(v[2] for v in want.values())
    assert licenses.scan(df.where("false")).count() == 0


def test_every_match_has_a_telling_word():
    for least in (0.5, 0.8, 1.0):
        telling = set(licenses.telling_words(licenses.TEMPLATES, least))
        for _, t in licenses.TEMPLATES:
            g = grams(words(t))
            without = [s for s in g if not set(s) & telling]
            assert len(without) < least * len(g)


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("PythonRDD", ""))
    with pytest.raises(ValueError):
        licenses.scan(df, templates=[("x", "too short")])


def test_short_texts_with_and_without_ansi(spark):
    docs = spark.createDataFrame([(1, "License"), (2, "Released under the MIT License"), (3, ""), (4, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            assert [(r.doc_id, r.license) for r in licenses.scan(docs).collect()] == [(2, "MIT")]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_texts_are_split_once_and_template_hashes_are_values(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "arrays_overlap" not in plan
