"""Similarity joins and clustering against brute force; de-duplication cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conceptmine.functions import vectors as vx
from conceptmine.operators import clustering, dedup, similarity
from conceptmine.operators.encode import encode_distinct, encoder_column, ngram_encoder
from conceptmine.operators.ranking import first_wins, last_wins, numbered
from conceptmine.operators.skew import salted_join


def frame(spark, vectors, key="id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} bigint, vec array<double>")


def cosines(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    with np.errstate(invalid="ignore"):
        return (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))


def greedy(vectors, t):
    """The sequential loop, for comparison."""
    sims, n = cosines(vectors, vectors), len(vectors)
    own = [None] * n
    for i in range(n):
        if own[i] is None:
            own[i] = i
            for j in range(i + 1, n):
                if own[j] is None and sims[i, j] > t:
                    own[j] = i
    return own


def clustered(rng, n, dim, centres, noise):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, dim))


@pytest.mark.parametrize("limit", [similarity.MAX_BROADCAST_VALUES, 0])
@pytest.mark.parametrize("t", [0.3, 0.9])
def test_join_equals_brute_force(spark, monkeypatch, limit, t):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    a, b = clustered(rng, 120, 8, 6, 0.3), clustered(rng, 90, 8, 6, 0.3)
    a[3] = 0
    want = {(i, j) for i, j in zip(*np.nonzero(cosines(a, b) >= t))}
    rows = similarity.similarity_join(frame(spark, a), frame(spark, b), t, max_broadcast_values=limit).collect()
    assert len(rows) == len(want) and {(r["left_id"], r["right_id"]) for r in rows} == want
    assert all(abs(r["score"] - cosines(a, b)[r["left_id"], r["right_id"]]) < 1e-12 for r in rows)


def test_blocks_cut_a_crowded_cell(spark, monkeypatch):
    """All rows in one small ball: one cell, many blocks, still every pair once."""
    rng = np.random.default_rng(7)
    points = np.array([1.0, 0, 0, 0]) + 0.01 * rng.normal(size=(150, 4))
    want = int(np.triu(cosines(points, points) > 0.999, 1).sum())
    df = frame(spark, points, "ord")
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    pairs = similarity.similar_pairs(df, 0.999, max_broadcast_values=0)
    assert pairs.count() == pairs.distinct().count() == want


def test_threshold_is_inclusive_in_joins_and_strict_in_pairs(spark):
    df = frame(spark, [[1, 0], [1, 1], [1, 0]], "ord")
    half = 1.0 / (1.0 * np.sqrt(2.0))
    joined = similarity.similarity_join(df, df, half, left_key="ord", right_key="ord")
    assert joined.where("left_id = 0").count() == 3
    strict = {(r["a"], r["b"]) for r in similarity.similar_pairs(df, half).collect()}
    assert strict == {(0, 2)}


@pytest.mark.parametrize("dim", [8, 200])
@pytest.mark.parametrize("t", [0.2, 0.95])
def test_pairs_of_one_table_come_once(spark, monkeypatch, dim, t):
    """Broadcast, one cell of blocks, and cells; narrow vectors and such with a leading part."""
    rng = np.random.default_rng(8)
    points = clustered(rng, 160, dim, 9, 0.05 if dim > 8 else 0.2)
    points[:, dim // 2:] *= 0.1
    sims = cosines(points, points)
    want = {(i, j) for i, j in zip(*np.nonzero(sims > t)) if i < j}
    assert len(want) > 100
    df = frame(spark, points, "ord")
    for rows, share, limit in ((2048, 4, similarity.MAX_BROADCAST_VALUES), (16, 1e9, 0), (16, 0, 0), (2048, 4, 0)):
        monkeypatch.setattr(similarity, "BLOCK_ROWS", rows)
        monkeypatch.setattr(similarity, "CELL_SHARE", share)
        got = [(r["a"], r["b"]) for r in similarity.similar_pairs(df, t, max_broadcast_values=limit).collect()]
        assert len(got) == len(want) and set(got) == want
        assert all(abs(r["score"] - sims[r["a"], r["b"]]) < 1e-12 for r in similarity.similar_pairs(df, t).collect())


def test_leading_components_leave_out_no_pair():
    rng = np.random.default_rng(3)
    a, b = (rng.normal(size=(300, 256)) * np.linspace(3, 0.01, 256) for _ in range(2))
    b[:50] = a[:50] + 0.1 * rng.normal(size=(50, 256))
    for t in (0.9, 0.3, -0.2):
        i, j, _ = similarity.hits(similarity.Side(a), similarity.Side(b), t, False)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*[x.tolist() for x in np.nonzero(cosines(a, b) >= t)]))


def test_half_the_products_and_few_copies(spark, monkeypatch):
    """Products of a table with itself, and copies of right rows, at a threshold where cells prune nothing."""
    rng = np.random.default_rng(4)
    points = rng.normal(size=(400, 16))
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    monkeypatch.setattr(similarity, "RESIDENT_VALUES", 16 * 100)
    seen = spark.sparkContext.accumulator(0)
    feed = similarity.Pairs.feed

    def counted(self, ids, vectors, own):
        seen.add(len(self.side) * len(ids) // (2 if own else 1))
        return feed(self, ids, vectors, own)

    monkeypatch.setattr(similarity.Pairs, "feed", counted)
    similarity.similar_pairs(frame(spark, points, "ord"), 0.65, max_broadcast_values=0).count()
    assert seen.value < 0.6 * 400 * 400
    rows = similarity.prepared(frame(spark, points), "id", "vec")
    assert similarity._cells(rows, rows, 400, 400, 16, 0.65, False) is None


def test_missing_vector_stays_alone(spark):
    df = spark.createDataFrame([(0, None), (1, [1.0]), (2, [2.0])], "ord bigint, vec array<double>")
    got = {r["ord"]: r["leader"] for r in clustering.leader_clusters(df, 0.5).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_zero_vectors_match_nothing(spark):
    df = frame(spark, [[0, 0], [0, 0], [1, 0]])
    assert similarity.similarity_join(df, df, -1.0).count() == 1
    pairs = df.alias("a").crossJoin(df.alias("b")).select(vx.cosine(F.col("a.vec"), F.col("b.vec")).alias("c"))
    assert pairs.where("c IS NULL").count() == 8


def test_empty_sides(spark):
    df, none = frame(spark, [[1, 0]]), frame(spark, [[1, 0]]).limit(0)
    assert similarity.similarity_join(df, none, 0.5).count() == 0
    assert similarity.similarity_join(none, df, 0.5).count() == 0
    assert similarity.similarity_join(none, df, 0.5, max_broadcast_values=0).count() == 0


@pytest.mark.parametrize("limit", [similarity.MAX_BROADCAST_VALUES, 0])
def test_clusters_equal_the_sequential_loop(spark, monkeypatch, limit):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(11)
    points = clustered(rng, 150, 6, 12, 0.35)
    got = clustering.leader_clusters(frame(spark, points, "ord"), 0.8, max_broadcast_values=limit).collect()
    assert {r["ord"]: r["leader"] for r in got} == dict(enumerate(greedy(points, 0.8)))


def test_chain_copies_and_blank_rows(spark):
    """a~b~c with a!~c, a third of all rows equal, and rows without direction."""
    angle = np.deg2rad([0, 20, 40, 60, 80])
    chain = [[np.cos(x), np.sin(x)] for x in angle]
    points = [[0, 0], *chain, *([[5.0, 5.0]] * 6), [0, 0], [10.0, 10.0]]
    logged = []
    got = clustering.leader_clusters(frame(spark, points, "ord"), np.cos(np.deg2rad(21)), log=logged.append).collect()
    assert {r["ord"]: r["leader"] for r in got} == dict(enumerate(greedy(points, np.cos(np.deg2rad(21)))))
    assert logged


def line(n, turn):
    angle = np.deg2rad(np.arange(n) * turn)
    return np.stack([np.cos(angle), np.sin(angle)], axis=1)


@pytest.mark.parametrize("limit", [similarity.MAX_BROADCAST_VALUES, 0])
def test_long_sorted_chain_takes_rounds_by_its_logarithm(spark, monkeypatch, limit):
    """Each row is close only to the next."""
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 512)
    n = 10_000 if limit else 1000
    points, t = line(n, 340 / n), np.cos(np.deg2rad(1.5 * 340 / n))
    logged = []
    got = clustering.leader_clusters(frame(spark, points, "ord"), t, limit, log=logged.append).collect()
    assert {r["ord"]: r["leader"] for r in got} == {i: i - i % 2 for i in range(n)}
    assert len(logged) < 20


@pytest.mark.parametrize("limit, listed", [(similarity.MAX_BROADCAST_VALUES, (1, 0)), (0, (3, 0))])
def test_crowded_rows_are_listed_again(spark, monkeypatch, limit, listed):
    """Rows next to more others than are listed: a sorted line, where the list holds members only."""
    monkeypatch.setattr(clustering, "LEAST_LISTED", listed[0])
    monkeypatch.setattr(clustering, "LISTED", listed[1])
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    for points, t in ((line(25, 4), np.cos(np.deg2rad(17))), (clustered(rng, 90, 5, 3, 0.3), 0.7)):
        got = clustering.leader_clusters(frame(spark, points, "ord"), t, limit).collect()
        assert {r["ord"]: r["leader"] for r in got} == dict(enumerate(greedy(points, t)))


def test_threshold_must_be_below_one(spark):
    with pytest.raises(ValueError):
        clustering.leader_clusters(frame(spark, [[1, 0]], "ord"), 1.0)


CONCEPT = ("ord bigint, name string, summary string, docstring string, source_code string, type string, "
           "is_target_subclass boolean, base_classes array<string>, vec array<double>")


def concept(ord_, type_="Class", target=False, bases=(), doc="doc", source="", vec=(1.0, 0.0)):
    return (ord_, f"/fw/m.c{ord_}", f"s{ord_}", doc, source, type_, target, list(bases), list(vec))


@pytest.mark.parametrize("rows, best", [
    ([concept(0, doc="Deprecated since 2."), concept(1, "Function")], 1),
    ([concept(0, source="@deprecate_func"), concept(1)], 1),
    ([concept(0), concept(1, target=True)], 1),
    ([concept(0, "Function"), concept(1)], 1),
    ([concept(0), concept(1, bases=["Gate"])], 1),
    ([concept(0), concept(1, doc="longer doc")], 1),
    ([concept(0), concept(1)], 0),
])
def test_best_of_cluster(spark, rows, best):
    kept, audit = dedup.semantic_dedup(spark.createDataFrame(rows, CONCEPT), 0.95)
    assert [r["ord"] for r in kept.collect()] == [best]
    assert [(r["removed"], r["kept"]) for r in audit.collect()] == [(f"/fw/m.c{1 - best}", f"/fw/m.c{best}")]


def test_similarity_equal_to_threshold_keeps_both(spark):
    rows = [concept(0, vec=(1.0, 0.0)), concept(1, vec=(1.0, 1.0))]
    kept, _ = dedup.semantic_dedup(spark.createDataFrame(rows, CONCEPT), 1.0 / np.sqrt(2.0))
    assert kept.count() == 2


def test_wrappers_go_only_within_their_module(spark):
    rows = [("/fw/m.BigGate", "Class"), ("/fw/m.big_gate", "Function"), ("/fw/n.big_gate", "Function"),
            ("/fw/m.other", "Function")]
    df = spark.createDataFrame([(n, t, n) for n, t in rows], "name string, type string, summary string")
    assert sorted(r["name"] for r in dedup.drop_wrappers(df, "/fw/").collect()) == [
        "/fw/m.BigGate", "/fw/m.other", "/fw/n.big_gate"]
    audit = dedup.wrapper_audit(df, "/fw/").collect()
    assert [(r["removed"], r["reason"]) for r in audit] == [("/fw/m.big_gate", "Wrapper for class /fw/m.BigGate")]


def test_encoder_is_deterministic_and_sees_each_text_once(spark):
    texts = spark.createDataFrame([("hadamard gate",), ("hadamard gate",), ("",), (None,)], "t string")
    rows = {r["text"]: r["vec"] for r in encode_distinct(texts, "t", encoder_column(ngram_encoder(32))).collect()}
    assert set(rows) == {"hadamard gate", ""}
    assert rows["hadamard gate"] == ngram_encoder(32)()(["hadamard gate"])[0].tolist()


def test_encoder_stage_works_in_place_and_keeps_nulls(spark):
    from conceptmine.operators.encode import EncoderStage, with_vectors
    texts = spark.createDataFrame([(i, None if i % 3 == 0 else f"text {i}") for i in range(20)], "i int, t string").coalesce(2)
    stage, column = EncoderStage(ngram_encoder(16), batch=4), encoder_column(ngram_encoder(16))
    out = [{r.i: r.vec for r in with_vectors(texts, "t", e).collect()} for e in (stage, column)]
    assert out[0] == out[1] and [i for i, v in out[0].items() if v is None] == [0, 3, 6, 9, 12, 15, 18]
    assert out[0][1] == ngram_encoder(16)()(["text 1"])[0].tolist()
    plan = with_vectors(texts, "t", stage)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan


def test_first_and_last_win(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), ("a", 3, None)], "k string, o int, v string")
    assert sorted(map(tuple, first_wins(df, ["k"], [F.col("o")]).collect())) == [("a", 1, "y"), ("b", 1, "z")]
    assert sorted(map(tuple, last_wins(df, ["k"], [F.col("o")]).collect())) == [("a", 3, None), ("b", 1, "z")]


def test_row_numbers_are_consecutive(spark):
    df = spark.range(1000).select((1000 - F.col("id")).alias("v")).repartition(7)
    rows = numbered(df, [F.col("v")], "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001)) == [r["v"] for r in rows]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(600).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 9).alias("k"), "id")
    left = left.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, CAST(-1 AS BIGINT) AS id"))
    right = spark.createDataFrame([(0, "a"), (0, "b"), (5, "c")], "k bigint, w string")
    got = salted_join(left, right, "k", how, hot_rows=50).select("k", "id", "w")
    want = left.join(right, "k", how).select("k", "id", "w")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_many_hot_keys_are_all_spread(spark):
    left = spark.range(4500).select((F.col("id") % 1500).alias("k"), "id")
    right = spark.range(1500).select(F.col("id").alias("k"), F.lit("w").alias("w"))
    got = salted_join(left, right, "k", hot_rows=1)
    assert got.count() == 4500 and got.select("id").distinct().count() == 4500


@pytest.mark.parametrize("limit", [similarity.MAX_BROADCAST_VALUES, 0])
def test_vectors_that_are_no_numbers_stay_alone(spark, limit):
    df = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [float("nan"), 1.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0])], "ord long, vec array<double>")
    got = {r["ord"]: r["leader"] for r in clustering.leader_clusters(df, 0.9, limit).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}
    pairs = similarity.similarity_join(df, df, 0.5, left_key="ord", right_key="ord", max_broadcast_values=limit)
    assert sorted((r["left_id"], r["right_id"]) for r in pairs.collect()) == [(3, 3), (3, 4), (4, 3), (4, 4)]


def test_exact_check_holds_a_bounded_number_of_products():
    import tracemalloc
    side = similarity.Side(np.ones((800, 768)))
    tracemalloc.start()
    i, _, _ = similarity.hits(side, side, 0.9, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(i) == 800 * 800 and peak < 150e6  # all products at once would take 3.9 GB


def test_products_of_a_block_are_bounded(monkeypatch):
    rnd = np.random.default_rng(2)
    block, seen, hits = rnd.normal(size=(9000, 8)), [], clustering.hits
    monkeypatch.setattr(clustering, "hits", lambda a, b, t, s: seen.append(len(a) * len(b)) or hits(a, b, t, s))
    found = clustering.Earlier(pa.array(np.arange(9000)), similarity.Side(block, resident=False), 0.9, 5)
    got = [r for b in found.meet(np.arange(512), similarity.Side(block[:512], resident=False)) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert max(seen) <= similarity.SLICE_VALUES < 9000 * 512
    unit = block / np.linalg.norm(block, axis=1, keepdims=True)
    near = unit @ unit[:512].T > 0.9
    assert got == [(v, u) for v in range(9000) for u in [u for u in np.flatnonzero(near[v]).tolist() if u < v][:5]]


def test_rows_pass_a_large_block_many_at_a_time(monkeypatch):
    rnd = np.random.default_rng(5)
    block, passing, seen, hits = rnd.normal(size=(9001, 8)), rnd.normal(size=(600, 8)), [], similarity.hits
    monkeypatch.setattr(similarity, "hits", lambda a, b, t, s: seen.append((len(a), len(b))) or hits(a, b, t, s))
    for own in (False, True):
        seen.clear()
        pairs = similarity.Pairs(pa.array(np.arange(9001)), similarity.Side(block), 0.9, False, once=True)
        found = [r for b in pairs.feed(pa.array(np.arange(3000, 3600)), passing, own) for r in zip(*(c.to_pylist() for c in b.columns))]
        i, j = np.nonzero(cosines(passing, block) >= 0.9)
        want = [(min(v, u + 3000), max(v, u + 3000)) for u, v in zip(i.tolist(), j.tolist()) if not own or v < u + 3000]
        assert sorted((a, b) for a, b, _ in found) == sorted(want) and want
        assert max(a * b for a, b in seen) <= similarity.SLICE_VALUES and seen[0][0] >= 256


@pytest.mark.parametrize("rows, columns, share", [(0, 0, 0), (0, 5, 0), (5, 0, 0), (1, 1, 1), (3, 5, 0.5), (7, 9, 0.1), (64, 16, 0), (200, 177, 0.01), (40, 8, 1)])
def test_true_values_come_by_row_then_column(rows, columns, share):
    near = np.random.default_rng(6).random((rows, columns)) < share
    for got, want in zip(similarity._true(near), np.nonzero(near), strict=True):
        assert got.tolist() == want.tolist()


def test_block_pairs_are_dealt_out_evenly(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    monkeypatch.setattr(similarity, "RESIDENT_VALUES", 16 * 40)
    rows = similarity.prepared(frame(spark, np.random.default_rng(8).normal(size=(400, 16))), "id", "vec")

    class Counted:
        def feed(self, ids, vectors, own):
            return iter(())

        def finish(self):
            yield pa.RecordBatch.from_arrays([pa.array([1])], ["n"])

    pairs = similarity.block_join(rows, rows, 16, 0.1, lambda ids, side: Counted(), "n long")
    shares = [r["n"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert sum(shares) == 20 and len(shares) == 4 and max(shares) - min(shares) <= 1
