"""Lookup, statistics, coverage, agreement, repositories, readers, writers and flows."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from conceptmine.operators import agreement, coverage, lookup, repos, stats
from conceptmine.operators.code import PROFILE_A
from conceptmine.operators.encode import encoder_column, ngram_encoder
from conceptmine.plans import pipeline
from conceptmine.sinks import export
from conceptmine.sources import catalogue, scan, tables


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- lookup -------------------------------------------------------------------------------

KB = "file_no int, ord bigint, name string, pattern string"


def test_lookup_tiers(spark):
    kb = spark.createDataFrame([
        (0, 1, "/fw/a.Full", "P1"), (0, 2, "/fw/b.Short", "P2"), (0, 3, "Suffix", "P3"), (0, 4, "ySuffix", "P4"),
        (0, 5, "", "P5"), (0, 6, "/fw/no.Pattern", "")], KB)
    names = ["/fw/a.Full", "/other/z.Short", "/fw/c.mySuffix", "/fw/c.None", "/fw/no.Pattern"]
    concepts = spark.createDataFrame([(n, "s") for n in names], "name string, summary string")
    resolved = lookup.resolve_patterns(concepts, lookup.pattern_map(kb))
    got = {r["name"]: (r["pattern"], r["tier"]) for r in resolved.collect()}
    assert got == {"/fw/a.Full": ("P1", "full"), "/other/z.Short": ("P2", "short"),
                   "/fw/c.mySuffix": ("P3", "suffix"), "/fw/c.None": (None, "none"), "/fw/no.Pattern": (None, "none")}
    assert rows(lookup.mapping_summary(resolved)) == [(3, 5)]
    assert sorted(rows(lookup.unclassified(resolved))) == [("/fw/c.None", "s"), ("/fw/no.Pattern", "s")]


@pytest.mark.parametrize("chars", [lookup.MAX_KEY_CHARS, 0])
def test_lookup_by_trie_and_by_joins(spark, chars):
    """Both ways against a loop over all keys."""
    import random
    rnd = random.Random(6)
    text = lambda: "".join(rnd.choice("ab./é") for _ in range(rnd.randrange(1, 7)))
    kb = [(0, i, text(), rnd.choice(["P1", "P2", "N/A", "P3"])) for i in range(40)]
    names = [text() + rnd.choice(["", text()]) for _ in range(150)] + [None, ""]
    keys = {}
    for _, _, n, p in kb:
        keys[n] = p
    short = lambda n: n.split("/")[-1].split(".")[-1]
    shorts = {short(n): p for n, p in keys.items()}

    def plain(n):
        if n is None:
            return None, None
        if n in keys:
            return keys[n], "full"
        if short(n) in shorts:
            return shorts[short(n)], "short"
        found = next((p for k, p in keys.items() if n.endswith(k)), None)
        return found, "suffix" if found else "none"

    mapped = lookup.pattern_map(spark.createDataFrame(kb, KB))
    concepts = spark.createDataFrame([(n, i, "old") for i, n in enumerate(names)], "name string, i int, pattern string")
    got = {r.i: (r.pattern, r.tier) for r in lookup.resolve_patterns(concepts, mapped, chars).collect()}
    want = {i: (None if p == "N/A" else p, t) for i, (p, t) in enumerate(map(plain, names))}
    assert got == want and {t for _, t in want.values()} == {"full", "short", "suffix", "none", None}
    none = lookup.resolve_patterns(concepts, mapped.limit(0), chars)
    assert {(r.pattern, r.tier) for r in none.collect()} == {(None, "none"), (None, None)}


def test_duplicate_keys_keep_first_place_and_last_value(spark):
    kb = spark.createDataFrame([
        (0, 1, "ab", "old"), (0, 2, "b", "B"), (1, 1, "ab", "new"), (1, 2, "x.n", "N1"), (2, 1, "y.n", "N2")], KB)
    mapped = lookup.pattern_map(kb)
    assert {r["name"]: r["pattern"] for r in mapped.collect()}["ab"] == "new"
    concepts = spark.createDataFrame([("zab", "s"), ("q.n", "s"), ("zab", "t")], "name string, summary string")
    got = sorted(rows(lookup.resolve_patterns(concepts, mapped).select("name", "summary", "pattern")))
    # 'ab' still stands before 'b'; the later 'n' wins among short names; copies stay copies
    assert got == [("q.n", "s", "N2"), ("zab", "s", "new"), ("zab", "t", "new")]


# --- statistics -----------------------------------------------------------------------------

FACTS = ("file_path string, concept_name string, pattern string, match_type string, matched_text string, "
         "similarity_score string")


@pytest.fixture
def matches(spark):
    return tables.with_origin(spark.createDataFrame([
        ("p1/a.py", "/fw/x.A", "P1", "name", "A", "0.95"), ("p1/a.py", "/fw/x.A", "P1", "name", "A", "0.85"),
        ("p2/b.py", "/lib/y.B", "P2", "summary", "b", "0.94"), ("p2/c.py", "/lib/y.C", "N/A", "summary", "c", "bad"),
        (None, None, None, None, None, None)], FACTS))


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "pattern string")


def test_basic_statistics(spark, matches):
    assert rows(stats.basic_statistics(matches, names(spark, "P1", "P2", "P3"))) == [(5, 2, pytest.approx(0.9133, abs=1e-4), 1)]
    assert rows(stats.unmatched_patterns(matches, names(spark, "P1", "P3", "P0"))) == [("P0",), ("P3",)]
    assert rows(stats.overview(matches))[0][:3] == (5, 3, 3)


def test_scores_that_are_no_numbers(spark):
    df = tables.with_origin(spark.createDataFrame(
        [("p/a.py", "/f/a", "P", "name", "t", s) for s in ("0.5", "NaN", "", None, "0.7")], FACTS))
    assert rows(stats.mean_score_by(df, "match_type")) == [("name", 0.6)]
    assert rows(export.match_output(df.where("similarity_score IS NULL")).select("similarity_score").distinct()) == [(None,)]


def test_empty_match_table(spark, matches):
    none = matches.limit(0)
    assert rows(stats.overview(none)) == [(0, 0, 0, 0.0)]
    assert rows(stats.basic_statistics(none, names(spark, "P1"))) == [(0, 0, 0.0, 1)]
    assert rows(stats.source_table(none)) == []


def test_null_keys_form_no_group(matches):
    assert rows(stats.counts_by(matches, "match_type")) == [("name", 2), ("summary", 2)]
    assert rows(stats.mean_score_by(matches, "match_type")) == [("summary", 0.94), ("name", 0.9)]
    assert rows(stats.patterns_in_frameworks(matches)) == [("fw", "P1", 2), ("lib", "P2", 1)]


def test_report_tables(spark, matches):
    assert rows(stats.source_table(matches)) == [("P1", 2, "fw"), ("P2", 1, "lib")]
    assert rows(stats.adoption_table(matches)) == [("P1", 2, 1, "p1"), ("P2", 1, 1, "p2")]
    assert rows(stats.top_concepts(matches, 2)) == [("/fw/x.A", "Fw", "...A", 2), ("/lib/y.B", "Lib", "...B", 1)]
    assert rows(stats.top_framework_concepts(matches, 1)) == [("fw", "/fw/x.A", 2)]
    watched = names(spark, "P2", "P9")
    assert rows(stats.watch_list(matches, watched)) == [("P2", 1), ("P9", 0)]
    assert rows(stats.watch_summary(matches, watched)) == [(1, 2)]
    assert rows(stats.found_watched(matches, watched)) == [("P2",)]


def test_tables_from_matches_and_from_their_base_are_equal(spark, matches):
    base = stats.base(matches)
    assert base.count() == 4 and base.where("pattern = 'P1'").select("_n", "_scored").first() == (2, 2)
    for fn in (stats.source_table, stats.adoption_table, stats.top_concepts, stats.patterns_in_frameworks, stats.concept_counts,
               lambda m: stats.counts_by(m, "project"), lambda m: stats.mean_score_by(m, "match_type"), lambda m: stats.watch_list(m, names(spark, "P1"))):
        assert rows(fn(base)) == rows(fn(matches))


def test_adoption_names_may_be_bounded(spark):
    df = tables.with_origin(spark.createDataFrame(
        [(f"p{i}/a.py", "/f/a", "P" if i else "Q", "name", "t", "0.5") for i in range(6)], FACTS))
    assert rows(stats.adoption_table(df, 2)) == [("P", 5, 5, "p1, p2 (+3 more)"), ("Q", 1, 1, "p0")]
    assert rows(stats.adoption_table(df))[0] == ("P", 5, 5, "p1, p2, p3, p4, p5")
    assert stats.adoption_projects(df).count() == 6


def test_overview_reads_the_matches_once_and_expands_nothing(spark, tmp_path, matches):
    matches.write.parquet(str(tmp_path / "m"))
    read = spark.read.parquet(str(tmp_path / "m"))
    written = []
    keep, stats.materialize = stats.materialize, lambda df: written.append(df) or keep(df)
    try:
        out = [stats.overview(read), stats.basic_statistics(read, names(spark, "P1"))]
    finally:
        stats.materialize = keep
    assert len(written) == 2
    for df in out:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and str(tmp_path / "m") not in plan


# --- coverage ---------------------------------------------------------------------------------

@pytest.fixture
def uses(spark):
    return spark.createDataFrame([
        ("A", "/a/x.1", "P1"), ("A", "/a/x.2", "P1"), ("A", "/a/x.3", "P1"), ("A", "/a/x.4", "P1"), ("A", "/a/x.4", "P1"),
        ("A", "/a/y", "P2"), ("B", "/b/z", " P2 "), ("B", "/b/n", ""), ("C", "/c/q", None)],
        "framework string, name string, pattern string")


def test_coverage(spark, uses):
    base = names(spark, "P1", "P5", "P6", "P7")
    assert rows(coverage.coverage(uses, base)) == [(1, 4, 25.0)]
    assert rows(coverage.coverage(uses, base.limit(0))) == [(0, 0, 0.0)]
    assert sorted(rows(coverage.framework_coverage(uses, base))) == [("A", 1, 4, 25.0), ("B", 0, 4, 0.0), ("C", 0, 4, 0.0)]
    assert sorted(rows(coverage.missing_and_extra(uses, base))) == [
        ("P2", "extra"), ("P5", "missing"), ("P6", "missing"), ("P7", "missing")]
    assert sorted(rows(coverage.pattern_counts(uses))) == [("A", 2), ("B", 1)]


def test_pattern_sources(spark, uses):
    assert sorted(rows(coverage.pattern_sources(uses))) == [
        ("A", "P1", 4, "x.1, x.2, x.3 (+1 more)"), ("A", "P2", 1, "y"), ("B", "P2", 1, "z")]
    assert sorted(rows(coverage.extra_pattern_sources(uses, names(spark, "P1")))) == [
        ("P2", "A", 1, "y"), ("P2", "B", 1, "z")]


def test_coverage_matrix(uses, spark):
    matrix = coverage.coverage_matrix(uses, ["A", "B", "C"])
    assert sorted(rows(matrix)) == [("P1", 1, 0, 0, 1), ("P2", 1, 1, 0, 2)]
    # a framework that is not listed still counts, and its patterns stay
    assert sorted(rows(coverage.coverage_matrix(uses, ["A"]))) == [("P1", 1, 1), ("P2", 1, 2)]
    assert sorted(rows(coverage.coverage_matrix(uses, ["C"]))) == [("P1", 0, 1), ("P2", 0, 2)]
    assert rows(coverage.common_patterns(matrix, ["A", "B"])) == [("P2",)]
    assert rows(coverage.pairwise_common(uses)) == [("A", "B", 1)]
    assert rows(coverage.only_in(uses, names(spark, "P2"))) == [("P1",)]


# --- agreement --------------------------------------------------------------------------------

RATERS = ["a", "b", "c"]


def ratings(spark, *values):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "item int, a string, b string, c string")


def test_perfect_agreement(spark):
    df = ratings(spark, ("x", "x", "x"), ("y", " y", "y "))
    assert rows(agreement.fleiss_kappa(df, RATERS)) == [(1.0,)]
    assert sorted(rows(agreement.cohen_kappas(df, RATERS))) == [("a vs b", 1.0), ("a vs c", 1.0), ("b vs c", 1.0)]
    assert rows(agreement.lights_kappa(df, RATERS)) == [(1.0, "Almost perfect agreement")]


def test_no_agreement_and_missing_ratings(spark):
    df = ratings(spark, ("x", "y", "z"), ("y", "z", "x"), ("x", None, "x"))
    assert rows(agreement.fleiss_kappa(df, RATERS)) == [(pytest.approx(-0.5),)]
    # every pair: observed 0, chance 1/2 * 0 + ... from the remaining two rows
    got = dict(rows(agreement.cohen_kappas(df, RATERS)))
    assert got == {"a vs b": pytest.approx(-1 / 3), "a vs c": pytest.approx(-1 / 3), "b vs c": pytest.approx(-1 / 3)}
    assert sorted(rows(agreement.count_matrix(df, "item", RATERS)))[:3] == [(0, "x", 1), (0, "y", 1), (0, "z", 1)]


def test_single_category_has_no_kappa(spark):
    df = ratings(spark, ("x", "x", "x"), ("x", "x", "x"))
    assert math.isnan(rows(agreement.fleiss_kappa(df, RATERS))[0][0])
    assert all(math.isnan(k) for _, k in rows(agreement.cohen_kappas(df, RATERS)))


# --- repositories -------------------------------------------------------------------------------

AS_OF = dt.datetime(2024, 2, 29, 12, 0, tzinfo=dt.timezone.utc)
GOOD = dict(id=1, full_name="Org/Name", description="fine", topics=["code"], stargazers_count=50, forks_count=3,
            contributors_count=12, contributors_status=None, pushed_at=dt.datetime(2024, 1, 1), archived=False,
            fork=False, language="Python", html_url="u", source_ord=0, pos=0)


def repositories(spark, *changes):
    from conceptmine import schemas
    from pyspark.sql import types as T
    schema = T.StructType(schemas.REPOSITORY.fields + [
        T.StructField("source_ord", T.IntegerType()), T.StructField("pos", T.IntegerType())])
    data = [{**GOOD, "id": i, "pos": i, "full_name": f"Org/N{i}", **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in data], schema)


def test_every_rejection_reason_and_their_order(spark):
    cases = [
        ({}, None),
        ({"archived": True, "fork": True}, "Archived repository"),
        ({"fork": True, "stargazers_count": 1}, "Is a fork"),
        ({"stargazers_count": 29, "pushed_at": dt.datetime(2000, 1, 1)}, "Not enough stars (29 < 30)"),
        ({"pushed_at": dt.datetime(2023, 2, 28, 11, 59)}, "Inactive since 2023-02-28"),
        ({"pushed_at": dt.datetime(2023, 2, 28, 12, 0)}, None),
        ({"description": "Many BOOKS", "topics": ["awesome-list"]}, "Excluded by Topic 'awesome-list'"),
        ({"description": "Many BOOKS", "topics": []}, "Excluded by Keyword 'books' in name/description"),
        ({"topics": ["Books"], "contributors_count": 1}, "Excluded by Topic 'books'"),
        ({"contributors_count": 9}, "Not enough contributors (9 < 10)"),
        ({"contributors_count": None}, None),
        ({"contributors_count": None, "contributors_status": 403},
         "Could not fetch contributors due to API limits (403)"),
        ({"description": None}, None),
    ]
    got = repos.with_reason(repositories(spark, *[c for c, _ in cases]), AS_OF).orderBy("pos").collect()
    assert [r["reason"] for r in got] == [want for _, want in cases]


def test_rank_cull_and_funnel(spark):
    df = repositories(spark, {"stargazers_count": 40}, {"stargazers_count": 60}, {"stargazers_count": 40}, {"fork": True})
    top = repos.ranked(df, AS_OF, top=2)
    assert sorted((r["rank"], r["full_name"]) for r in top.collect()) == [(1, "Org/N1"), (2, "Org/N0")]
    judged = repos.verdicts(df, AS_OF, top=2)
    assert rows(repos.funnel(judged)) == [(4, 2, 2)]
    assert rows(repos.rejected(judged)) == [
        ("Org/N2", "Passed filters but not in top 2 by stars (40 stars)"), ("Org/N3", "Is a fork")]


def test_candidate_and_id_dedup(spark):
    df = repositories(spark, {"id": 7, "full_name": "x", "source_ord": 1}, {"id": 7, "full_name": "x", "language": "C"})
    assert [r["source_ord"] for r in repos.candidates(df).collect()] == [0]
    assert [(r["language"], r["first_seen"]["source_ord"]) for r in repos.latest_by_id(df).collect()] == [("Python", 0)]


def test_survey_cap_counts_accepted_rows(spark):
    df = repositories(spark, {"fork": True, "stargazers_count": 90}, {"stargazers_count": 80}, {"stargazers_count": 70},
                      {"stargazers_count": 9})
    assert sorted(r["id"] for r in repos.survey(df, cap=2).collect()) == [1, 2]


def test_language_tables(spark):
    df = repositories(spark, {}, {"language": "Jupyter Notebook"}, {"language": None}, {"language": ""})
    dist = repos.language_distribution(df)
    assert sorted(rows(dist)) == [("Jupyter Notebook", 1, 25.0), ("Python", 1, 25.0), ("Unknown/Docs", 2, 50.0)]
    assert sorted(rows(repos.ranked_languages(dist)))[0] == (1, "Unknown/Docs", 2, "50.00%")
    assert rows(repos.ecosystem_share(dist)) == [(50.0, 50.0)]
    doc = json.loads(rows(export.language_json(dist, ["q"], "t"))[0][0])
    assert doc["meta"] == {"total_repos": 4, "queries": ["q"], "timestamp": "t"}
    assert doc["distribution"] == {"Unknown/Docs": 2, "Python": 1, "Jupyter Notebook": 1}


# --- catalogue, readers, writers ------------------------------------------------------------------

def test_catalogue(spark):
    listing = json.dumps({"_embedded": {"patternModels": [
        {"id": "1", "name": "N", "patternLanguageId": "L"}, {"id": "", "name": "X", "patternLanguageId": "L"},
        {"id": "2", "name": "Y"}]}})
    df = spark.createDataFrame([(listing,), ("{}",)], "json string")
    assert rows(catalogue.entries(df)) == [("1", "N", "L")]
    answers = spark.createDataFrame([
        ("N", json.dumps({"renderedContent": {"Intent": "<p>a</p> <b>b</b>", "Alias": "—"}})), ("E", "{}")],
        "name string, json string")
    missing = "Not available"
    assert rows(catalogue.details(answers)) == [("N", "a b", "—", missing, missing, missing, missing)]


def test_knowledge_base_dialect(spark, tmp_path):
    good = tmp_path / "kb.csv"
    good.write_text('name,summary,pattern\n/a.B,"line one\nline ""two"", \\ end", P1 \n/a.C,short\n/a.D,s,P2\n')
    kb = tables.read_knowledge_base(spark, {"fw": str(good), "gone": str(tmp_path / "none.csv")})
    got = kb.orderBy("ord").collect()
    assert [(r["framework"], r["name"], r["pattern"]) for r in got] == [("fw", "/a.B", "P1"), ("fw", "/a.D", "P2")]
    assert got[0]["summary"] == 'line one\nline "two", \\ end'
    assert sorted(rows(tables.pattern_names(kb))) == [("P1",), ("P2",)]
    export.write_knowledge_base(kb, str(tmp_path / "all"))
    assert spark.read.csv(str(tmp_path / "all"), header=True, **tables.CSV).columns[0] == "framework"
    with pytest.raises(FileNotFoundError):
        tables.read_knowledge_base(spark, {"fw": str(tmp_path / "none.csv")})


def test_other_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name;summary\n/a.B;x, y\n")
    assert rows(tables.read_concepts_csv(spark, {"fw": (str(tmp_path / "c.csv"), ";")})) == [("fw", "/a.B", "x, y")]
    (tmp_path / "c.json").write_text(json.dumps([{"name": "n", "summary": "s"}, {"name": "x"}]))
    assert [r["name"] for r in tables.read_concepts_json(spark, [str(tmp_path / "c.json"), "/none.json"]).collect()] == ["n"]
    (tmp_path / "list.csv").write_text("P1\n P2 \n\nP1\n")
    assert sorted(rows(tables.read_pattern_list(spark, str(tmp_path / "list.csv"), header=False))) == [("P1",), ("P2",)]
    (tmp_path / "cols.csv").write_text("pattern,x\n P1,1\n,2\n")
    assert rows(tables.read_pattern_column(spark, str(tmp_path / "cols.csv"))) == [("P1",)]
    (tmp_path / "lines.txt").write_text(" a/b \n\nc/d\n")
    assert rows(tables.read_lines(spark, str(tmp_path / "lines.txt"))) == [("a/b",), ("c/d",)]
    (tmp_path / "dist_1.json").write_text(json.dumps({"meta": {"total_repos": 3}, "distribution": {"C": 3}}))
    latest = tables.latest_file(spark, str(tmp_path), "dist_*.json")
    assert rows(tables.read_language_distribution(spark, latest)) == [(3, None, "C", 3)]
    (tmp_path / "cat.json").write_text(json.dumps([{"name": "N", "intent": "i", "extra": 1}]))
    assert tables.read_catalogue(spark, str(tmp_path / "cat.json")).first()["intent"] == "i"
    (tmp_path / "r.csv").write_text("a,b,c\nx,y,\n")
    assert rows(tables.read_ratings(spark, str(tmp_path / "r.csv"), RATERS)) == [("x", "y", None)]
    assert tables.latest_file(spark, str(tmp_path), "none_*") is None


def test_match_table_round_trip(spark, tmp_path, matches):
    pq, csv = str(tmp_path / "m"), str(tmp_path / "m_csv")
    export.write_matches(matches.where("file_path IS NOT NULL"), pq, csv)
    back = tables.read_matches(spark, csv)
    assert back.count() == 4 and back.where("pattern IS NULL").count() == 1
    assert rows(stats.source_table(back)) == rows(stats.source_table(matches))
    with pytest.raises(FileNotFoundError):
        tables.read_matches(spark, str(tmp_path / "none"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        tables.read_matches(spark, str(tmp_path / "empty.csv"))


def test_report_bundle(spark, tmp_path, matches):
    defined, watched = names(spark, "P1", "P2", "P3"), names(spark, "P2", "W1")
    written = export.write_report(matches, defined, watched, str(tmp_path / "all"))
    assert len(written) == 12
    per = spark.read.option("header", True).csv(str(tmp_path / "all/patterns_in_frameworks"))
    assert sorted(rows(per.select("framework", "pattern"))) == [("fw", "P1"), ("lib", "P2")]
    bare = matches.withColumn("pattern", F.lit(None).cast("string"))
    assert len(export.write_report(bare, defined.limit(0), watched, str(tmp_path / "bare"))) == 5


def test_concept_writers(spark, tmp_path):
    df = spark.createDataFrame([("/fw/a.B", 's "q"', "d", "class B: pass"), ("/fw/a.C", None, "d", "")],
                               "name string, summary string, docstring string, source_code string")
    export.write_concepts_json(df, str(tmp_path / "j"))
    assert "source_code" not in spark.read.json(str(tmp_path / "j")).columns
    export.write_concepts_csv(df, str(tmp_path / "c"), ";")
    back = tables.read_concepts_csv(spark, {"fw": (str(tmp_path / "c"), ";")})
    assert sorted(r["summary"] or "" for r in back.collect()) == ["", 's "q"']
    export.write_snippets(df, str(tmp_path / "s"))
    assert rows(spark.read.parquet(str(tmp_path / "s")).select("framework", "snippet_key")) == [("fw", "fw_a_B")]
    resolved = df.select("name", "summary", F.lit("P").alias("pattern"))
    export.write_unclassified(resolved, str(tmp_path / "u"))
    assert spark.read.csv(str(tmp_path / "u"), schema="name string, summary string", header=True).count() == 0
    export.write_pattern_list(names(spark, "b", "a", "b"), str(tmp_path / "p"))
    assert sorted(rows(tables.read_pattern_list(spark, str(tmp_path / "p")))) == [("a",), ("b",)]


def test_repository_writers(spark, tmp_path):
    df = repositories(spark, {"contributors_count": None}, {"stargazers_count": 99})
    export.write_repositories(repos.ranked(df, AS_OF), str(tmp_path / "r"))
    got = {r["rank"]: r for r in spark.read.json(str(tmp_path / "r/ranked")).collect()}
    assert got[1]["full_name"] == "Org/N1" and got[2]["contributors_count"] == "N/A"
    assert got[1]["pushed_at"] == "2024-01-01T00:00:00Z"
    export.write_languages(repos.language_distribution(df), str(tmp_path / "l"))
    export.write_language_json(repos.language_distribution(df), str(tmp_path / "lj"), ["q"], "t")
    assert rows(tables.read_language_distribution(spark, str(tmp_path / "lj"))) == [(2, "t", "Python", 2)]


def test_shared_folder_is_the_sessions(spark, monkeypatch):
    from types import SimpleNamespace
    from conceptmine import session

    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    unset = SimpleNamespace(get=lambda key, default=None: "s3a://lake/warehouse/" if "warehouse" in key else default)
    assert session.shared_dir(SimpleNamespace(conf=unset)) == "s3a://lake/warehouse/conceptmine-shared"


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_plans_hold_no_pair_product(spark, uses, capsys):
    """Ranks are limited before their shuffle; lookups and pairs stay equi-joins."""
    from workload import mining, reporting, texts

    assert "WindowGroupLimit" in plan_of(coverage.pattern_sources(uses), capsys)
    for name in ("lookup_tiers", "top_concepts", "pairwise_common", "repo_verdicts", "missing_extra", "cohen_kappa"):
        fn = {**reporting.QUERIES, **mining.QUERIES, **texts.QUERIES}[name][0]
        plan = plan_of(fn(spark, "/root/testdata/sf0.001"), capsys)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_pushdown_reaches_the_scan(spark, capsys):
    from workload.inputs import facts

    plan = plan_of(stats.counts_by(facts(spark, "/root/testdata/sf0.001"), "pattern"), capsys)
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan


# --- scans and flows ------------------------------------------------------------------------------

@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    (root / "p1/sub").mkdir(parents=True)
    (root / "p2/tests").mkdir(parents=True)
    (root / "p1/sub/a.py").write_bytes(b"# hadamard transform of a register\nhadamard_transform(q)\nprint(1)\n\xff\n"
                                       .replace(b"\xff", b"# \xffend"))
    (root / "p2/tests/b.py").write_text("def broken(:\n# quantum phase estimation circuit\n")
    (root / "p2/n.ipynb").write_text("{}")
    (root / "top.py").write_bytes(b"print(2)\r\nx = 1\r")
    return str(root)


def test_script_scan(spark, corpus):
    scripts = scan.scan_scripts(spark, corpus)
    got = {r["path"]: (r["project"], r["text"]) for r in scripts.collect()}
    assert set(got) == {"p1/sub/a.py", "p2/tests/b.py", "top.py"}
    assert got["p1/sub/a.py"][0] == "p1" and got["p1/sub/a.py"][1].endswith("# end\n")
    assert got["top.py"] == ("top.py", "print(2)\nx = 1\n")
    assert sorted(rows(scan.projects(scripts))) == [("p1",), ("p2",)]
    assert scan.scan_scripts(spark, corpus, ["tests", "build"]).count() == 2
    found = scan.scan_notebooks(spark, corpus)
    assert rows(scan.notebook_counts(found)) == [("p2", 1)] and found.first()["modified"] is not None
    assert scan.path_exists(spark, corpus) and not scan.path_exists(spark, corpus + "/none")


def test_matching_flow(spark, corpus):
    concepts = spark.createDataFrame([
        ("/fw/lib.HadamardTransform", "hadamard transform of a register"),
        ("/fw/lib.PhaseEstimation", "quantum phase estimation circuit")], "name string, summary string")
    kb = spark.createDataFrame([(0, 1, "x.HadamardTransform", "Transform")], KB)
    encode = encoder_column(ngram_encoder(512))
    found = pipeline.match(scan.scan_scripts(spark, corpus), pipeline.label(concepts, kb), encode, 0.6, 0.8)
    got = sorted((r["file_path"], r["concept_name"], r["pattern"], r["match_type"], r["matched_text"]) for r in found.collect())
    assert got == [
        ("p1/sub/a.py", "/fw/lib.HadamardTransform", "Transform", "name", "hadamard_transform"),
        ("p1/sub/a.py", "/fw/lib.HadamardTransform", "Transform", "summary", "hadamard transform of a register end"),
        ("p2/tests/b.py", "/fw/lib.PhaseEstimation", None, "summary", "quantum phase estimation circuit")]


def test_mining_flow(spark):
    text = ('class BigGate(Gate):\n    """Applies a big gate to qubits."""\n\ndef big_gate():\n    """Wrapper."""\n\n'
            'def other():\n    """Applies a big gate to qubits."""\n\ndef third():\n    """Something else entirely."""\n')
    files = spark.createDataFrame([("qiskit/circuit/library/m.py", text)], "path string, text string")
    kept, audit = pipeline.mine(files, PROFILE_A, encoder_column(ngram_encoder(128)))
    assert sorted(r["name"].split(".")[-1] for r in kept.collect()) == ["BigGate", "third"]
    assert [(r["removed"].split(".")[-1], r["kept"].split(".")[-1]) for r in audit.collect()] == [("other", "BigGate")]


def test_scratch_tables_are_removed_at_the_end_of_a_flow(spark):
    from pathlib import Path

    from conceptmine.session import drop_scratch, materialize, shared_dir
    drop_scratch(spark)
    before = set(Path(shared_dir(spark)).iterdir()) if Path(shared_dir(spark)).exists() else set()
    a, b = materialize(spark.range(5)), materialize(spark.range(6))
    assert (a.count(), b.count()) == (5, 6) and drop_scratch(spark) == 2 and drop_scratch(spark) == 0
    assert set(Path(shared_dir(spark)).iterdir()) == before
