"""The pipeline's stages against plain versions, on a small folder of tables."""

import random
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)

from conceptmine.llm import rows as row_tools  # noqa: E402
from test_decontaminate import plain as plain_hits  # noqa: E402
from test_ngram_join import shingles  # noqa: E402
from test_suffix_dedup import plain as plain_repeats, words  # noqa: E402


def corpus():
    rnd = random.Random(8)
    fresh = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(f"b{rnd.randrange(500)}" for _ in range(20))) for i in range(6)]
    passage, docs, toxic = fresh(70), [], set()
    for i in range(160):
        body = fresh(rnd.choice([3, 30, 120, 200]))
        if i % 4 == 0:
            body[1:1] = ["vile", "vilest"]
            toxic.add(i)
        elif i % 7 == 0:
            body += passage
        elif i % 9 == 0:
            body[10:10] = items[i % 6][1].split()
        docs.append((i, " ".join(body)))
        if i % 5 == 1 and i not in toxic:
            copy = body + ["more"] * (i % 3)
            docs += [(1000 + 3 * i + k, " ".join(copy)) for k in range(i % 3)]
    return docs + [(5000, None), (5001, "")], items, toxic


def test_stages_equal_plain_versions(spark, tmp_path):
    docs, items, toxic = corpus()
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    have = dict(docs)

    def after(name, df):
        df = stages[name](spark, df, str(tmp_path))
        path = f"{tmp_path}/{name}"
        df.write.parquet(path)
        df = spark.read.parquet(path)
        return df, {r.doc_id: r.text for r in df.collect()} if "text" in df.columns else df.collect()

    d, got = after("toxicity", spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert got == {i: t for i, t in have.items() if i not in toxic}

    d, now = after("ngram_jaccard_join", d)
    sets = {i: shingles(t, 5) for i, t in got.items()}
    group = {i: i for i in got}
    for i in sorted(got):
        for j in sorted(got):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    assert now == {i: t for i, t in got.items() if group[i] == i} and len(now) < len(got)

    d, cut = after("suffix_array_dedup", d)
    gone = plain_repeats([(i, t) for i, t in now.items() if t], 51)
    assert gone and set(now) - set(cut) == {i for i, g in gone.items() if len(g) == len(words(now[i]))}
    for i, t in cut.items():
        assert words(t) == [w for k, w in enumerate(words(now[i])) if k not in gone.get(i, ())]
        assert i in gone or t == now[i]

    d, clean = after("decontamination", d)
    hits = plain_hits(list(cut.items()), items)
    assert {i for i in cut if clean.get(i) != cut[i]} == {i for i, h in hits.items() if h[4]}
    again = plain_hits(list(clean.items()), items)
    assert not any(h[4] for h in again.values()) and any(h[4] for h in hits.values())

    _, packed = after("best_fit_packing", d)
    assert {r.doc_id for r in packed} == set(clean)
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 for p in places.values())
    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in run) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_near_copies_go_by_id_and_text(spark):
    """A copy takes no other text of its id with it, also where there is no id."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    docs = [(1, text("a")), (2, text("a") + " more"), (2, text("b")), (None, text("c")), (None, text("d")), (5, text("d") + " more"),
            (7, text("e")), (7, text("e") + " more"), (None, None), (2, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert len(got) == len(set(got)) == 7 and set(got) <= set(docs)
    assert {(1, text("a")), (2, text("b")), (None, text("c")), (None, text("d")), (None, None), (2, "")} < set(got)
    assert sum(i == 7 for i, _ in got) == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_named_like_those_of_the_helpers(spark):
    from conceptmine.llm import ngram_join, rows, suffix_dedup
    from conceptmine.session import materialize
    names = ["_hash", "_text_hash", "_id_hash", "_spans", "_own_spans", "spans", "text_hash", "kept", "_text", "a b"]
    passage = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame(
        [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([passage, passage, f"one {passage} two", None, "", "short"])],
        "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    groups = materialize(ngram_join.similar_groups(docs, n=5, num=80, den=100, count_links=False).select("doc_id", "text_hash", "kept"))
    kept = rows.one_per_group(docs, groups)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {0: passage, 2: "one  two", 3: None, 4: "", 5: "short"}
    assert all(r["a b"] == f"a b{r.doc_id}" and r._hash == f"_hash{r.doc_id}" for r in cut.union(kept).collect())


def test_batch_settings_come_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        with row_tools.small_batches(spark):
            assert spark.conf.get(key) == str(row_tools.BATCH_ROWS)
            raise KeyError
    except KeyError:
        assert spark.conf.get(key) == before


def test_texts_stay_in_the_jvm_when_copies_go(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    groups = docs.selectExpr("doc_id", "xxhash64(text) AS text_hash", "doc_id = 1 AS kept")
    kept = row_tools.one_per_group(docs, groups)
    assert [r.doc_id for r in kept.collect()] == [1]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_stages_are_written_in_small_batches(spark, tmp_path, monkeypatch):
    seen, write = [], row_tools.written
    monkeypatch.setattr(row_tools, "written", lambda df: seen.append(df.columns) or write(df))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, d, _: d) for n in "abc"])
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1 and len(seen) == 2
