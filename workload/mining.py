"""Similarity, code extraction, de-duplication and repository queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.functions import vectors as vx
from conceptmine.operators import clustering, code, dedup, repos, similarity
from conceptmine.operators.encode import encode_distinct
from conceptmine.operators.ranking import first_wins, numbered
from conceptmine.plans import pipeline
from workload.inputs import (
    HARVEST, REPOS, SQL_CAMEL, SQL_SNAKE, camel, letter_profile, repos_harvest, repositories, scripts, sql_cosine,
    sql_letter_profile, table, vectors, wide,
)

QUERIES = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


# --- similarity ---------------------------------------------------------------------------

_VEC = "v AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS vec, label FROM embeddings)"
_COS = sql_cosine("a.vec", "b.vec")
_JOIN = f"sims AS (SELECT a.ord AS left_id, b.ord AS right_id, {_COS} AS score FROM v a, v b)"


def _vector_join(spark, d, threshold, **options):
    v = vectors(spark, d)
    pairs = similarity.similarity_join(v, v, threshold, left_key="ord", right_key="ord", **options)
    return pairs.withColumn("score", F.round("score", 4))


@query("sim_name_join", f"""WITH {_VEC}, {_JOIN} SELECT left_id, right_id, round(score, 4) AS score
FROM sims WHERE score >= 0.35""")
def sim_name_join(spark, d):
    return _vector_join(spark, d, 0.35)


@query("sim_summary_join", f"""WITH {_VEC}, {_JOIN} SELECT left_id, right_id, round(score, 4) AS score
FROM sims WHERE score >= 0.3""")
def sim_summary_join(spark, d):
    return _vector_join(spark, d, 0.30)


@query("sim_cell_join", f"""WITH {_VEC}, {_JOIN} SELECT left_id, right_id, round(score, 4) AS score
FROM sims WHERE score >= 0.4""")
def sim_cell_join(spark, d):
    """The shuffled form that takes over once the right side is too large to broadcast."""
    return _vector_join(spark, d, 0.40, max_broadcast_values=0)


@query("match_union", f"""WITH {_VEC}, {_JOIN}
SELECT left_id, right_id, 'name' AS match_type, printf('%.4f', score) AS score_text FROM sims WHERE score >= 0.4
UNION ALL SELECT left_id, right_id, 'summary', printf('%.4f', score) FROM sims WHERE score >= 0.33""")
def match_union(spark, d):
    v = vectors(spark, d)

    def side(kind, threshold):
        pairs = similarity.similarity_join(v, v, threshold, left_key="ord", right_key="ord")
        return pairs.select("left_id", "right_id", F.lit(kind).alias("match_type"),
                            tx.score_text(F.col("score")).alias("score_text"))

    return side("name", 0.40).unionByName(side("summary", 0.33))


@query("similar_pairs", f"""WITH {_VEC}, {_JOIN} SELECT left_id AS a, right_id AS b, round(score, 4) AS score
FROM sims WHERE score > 0.35 AND left_id < right_id""")
def similar_pairs(spark, d):
    return similarity.similar_pairs(vectors(spark, d), 0.35).withColumn("score", F.round("score", 4))


@query("encode_texts", f"""SELECT text, {sql_letter_profile('text')}::FLOAT[] AS vec
FROM (SELECT DISTINCT p_name AS text FROM part UNION SELECT text FROM benchmark)""")
def encode_texts(spark, d):
    both = table(spark, d, "part").select(F.col("p_name").alias("text")).union(table(spark, d, "benchmark").select("text"))
    return encode_distinct(both, "text", letter_profile).select("text", "vec")


# --- matching -----------------------------------------------------------------------------

NAME_AT, SUMMARY_AT = 0.60, 0.75


def named_concepts(spark, d):
    """One resolved concept per part name: the first part by brand carries it."""
    part = table(spark, d, "part").select("p_name", "p_brand", "p_type", "p_partkey")
    first = first_wins(part, ["p_name"], [F.col("p_brand"), F.col("p_partkey")])
    return first.select(
        F.concat(F.lit("/"), "p_brand", F.lit("/lib."), F.element_at(F.split("p_name", " "), -1), F.lit("."),
                 F.replace("p_name", F.lit(" "), F.lit(""))).alias("name"),
        F.replace("p_name", F.lit(" "), F.lit("")).alias("short_name"),
        F.concat_ws(" ", "p_name", "p_type").alias("summary"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("pattern"))


def corpus(spark, d):
    """Event scripts and, as commented scripts, the documents."""
    docs = wide(spark, d, "documents").select(
        F.concat("source", F.lit("/d"), "doc_id", F.lit(".py")).alias("path"),
        F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# "))).alias("text"))
    return scripts(spark, d).unionByName(docs)


def matched(spark, d):
    from conceptmine.sources.tables import with_origin
    rows = pipeline.match(corpus(spark, d), named_concepts(spark, d), letter_profile, NAME_AT, SUMMARY_AT)
    return with_origin(rows)


_FIRST = """first AS (SELECT p_name, p_brand, p_type FROM part
  QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) = 1),
concepts AS (SELECT '/' || p_brand || '/lib.' || split_part(p_name, ' ', -1) || '.' || replace(p_name, ' ', '') AS name,
  replace(p_name, ' ', '') AS short_name, p_name || ' ' || p_type AS summary,
  CASE WHEN p_type <> 'PROMO' THEN p_type END AS pattern FROM first)"""
_ELEMENTS = """calls AS (SELECT 'u' || user_id || '/e' || event_id || '.py' AS path,
  unnest([event_type, 'helper', 'done']) AS element FROM events WHERE event_type <> 'error')"""


@query("script_matches", f"""WITH {_FIRST}, {_ELEMENTS},
blocks AS (SELECT source || '/d' || doc_id || '.py' AS path,
  array_to_string([y FOR y IN [trim(ltrim(trim(x), '# ')) FOR x IN string_split_regex(text, '[\\r\\n]+')] IF y <> ''], ' ')
  AS block FROM documents),
el AS (SELECT element, {sql_letter_profile('element')} AS vec FROM (SELECT DISTINCT element FROM calls)),
cn AS (SELECT *, {sql_letter_profile('short_name')} AS nv, {sql_letter_profile('summary')} AS sv FROM concepts),
bl AS (SELECT *, {sql_letter_profile('block')} AS vec FROM blocks WHERE block <> ''),
hits AS (SELECT element, name, pattern, {sql_cosine('el.vec', 'cn.nv')} AS score FROM el, cn)
SELECT path AS file_path, name AS concept_name, pattern, 'name' AS match_type, element AS matched_text,
  round(score, 4) AS similarity_score FROM calls JOIN hits USING (element) WHERE score >= {NAME_AT}
UNION ALL
SELECT path, name, pattern, 'summary',
  replace(CASE WHEN length(block) > 150 THEN block[1:150] || '...' ELSE block END, ';', ','),
  round({sql_cosine('bl.vec', 'cn.sv')}, 4) FROM bl, cn WHERE {sql_cosine('bl.vec', 'cn.sv')} >= {SUMMARY_AT}""")
def script_matches(spark, d):
    """Flow B from scripts to the match table."""
    return matched(spark, d).select(
        "file_path", "concept_name", "pattern", "match_type", "matched_text",
        F.round("similarity_score", 4).alias("similarity_score"))


@query("call_names", f"WITH {_ELEMENTS} SELECT path, element FROM calls")
def call_names(spark, d):
    return code.call_names(scripts(spark, d))


# --- concept extraction -------------------------------------------------------------------

def _join(*pieces):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def sdk_files(spark, d, root):
    """One module per part: a class with a method, a function with an inner class, and things to be left out.

    PROMO parts sit in an excluded folder, MEDIUM ones in a test file, STANDARD ones in a second folder.
    """
    part, snake = wide(spark, d, "part"), F.replace("p_name", F.lit(" "), F.lit("_"))
    kind = F.col("p_type")
    first, second = root
    folder = (F.when(kind == "PROMO", f"{first}templates/x/").when(kind == "STANDARD", second)
              .otherwise(F.concat(F.lit(first), F.lower("p_type"), F.lit("/"))))
    stem = F.when(kind == "MEDIUM", F.lit("test_m")).otherwise(F.lit("m"))
    base = F.when(F.col("p_size") > 25, "Gate").otherwise("object")
    text = _join(
        "import x\n\nclass ", camel(F.col("p_name")), "(", base, ", x.Other):\n    '''", F.col("p_name"), " of\n    ",
        F.col("p_brand"), ".\n\n    Size ", F.col("p_size"), ".'''\n    def method(self):\n        '''Method. Doc.'''\n\n",
        "def ", snake, "(n):\n    '''[Qmod core-library function]\n\n    Makes ", F.col("p_name"),
        ". Really. Yes.\n\n    .. math::\n\n        n + 1\n    '''\n    class Inner:\n        '''Inner.'''\n    return n\n\n",
        "def _hidden():\n    '''Hidden.'''\n\ndef get_it():\n    '''Getter.'''\n\ndef bare():\n    return 1\n\n",
        "async def later():\n    '''Later.'''\n    def inside():\n        '''Inside.'''\n\n",
        "class ", camel(F.col("p_name")), ":\n    '''Second of the name.'''\n")
    return part.select(_join(folder, stem, F.col("p_partkey"), ".py").alias("path"), text.alias("text"))


ROOT_A = ("qiskit/circuit/library/", "qiskit/circuit/library/")
ROOT_B = ("pennylane/templates/", "pennylane/elsewhere/")
ROOT_C = ("open_library/functions/", "qmod/builtins/functions/")


def _modules(prefix: str, root: tuple[str, str]) -> str:
    first, second = (r.replace("/", ".") for r in root)
    return f"""mods AS (SELECT *, {SQL_CAMEL} AS camel, {SQL_SNAKE} AS snake, '{prefix}' || CASE p_type
      WHEN 'PROMO' THEN '{first}templates.x.' WHEN 'STANDARD' THEN '{second}'
      ELSE '{first}' || lower(p_type) || '.' END
    || CASE p_type WHEN 'MEDIUM' THEN 'test_m' ELSE 'm' END || p_partkey || '.' AS module FROM part)"""


_A_ROWS = """
SELECT module || camel AS name, p_name || ' of ' || p_brand || '.' AS summary,
  p_name || ' of' || chr(10) || p_brand || '.' || chr(10) || chr(10) || 'Size ' || p_size || '.' AS docstring,
  'Class' AS type, p_size > 25 AS is_target_subclass,
  CASE WHEN p_size > 25 THEN 'Gate' ELSE 'object' END AS bases FROM kept
UNION ALL SELECT module || snake, '[Qmod core-library function]',
  '[Qmod core-library function]' || chr(10) || chr(10) || 'Makes ' || p_name || '. Really. Yes.',
  'Function', NULL, NULL FROM kept
UNION ALL SELECT module || 'Inner', 'Inner.', 'Inner.', 'Class', false, '' FROM kept
UNION ALL SELECT module || 'inside', 'Inside.', 'Inside.', 'Function', NULL, NULL FROM kept
"""


@query("concept_extract_a", f"""WITH {_modules('/qiskit/', ROOT_A)},
kept AS (SELECT * FROM mods WHERE p_type NOT IN ('PROMO', 'MEDIUM')) {_A_ROWS}""")
def concept_extract_a(spark, d):
    found = code.extract_concepts(sdk_files(spark, d, ROOT_A), code.PROFILE_A)
    return found.select("name", "summary", "docstring", "type", "is_target_subclass",
                        F.array_join("base_classes", ",").alias("bases"))


_B_SQL = f"""WITH {_modules('/pennylane/', ROOT_B)},
kept AS (SELECT * FROM mods WHERE p_type <> 'STANDARD')
SELECT name, summary, docstring FROM ({_A_ROWS}) WHERE type = 'Class'"""


@query("concept_extract_b", _B_SQL)
def concept_extract_b(spark, d):
    return code.extract_concepts(sdk_files(spark, d, ROOT_B), code.PROFILE_B).select("name", "summary", "docstring")


def api_names(spark, d):
    """Public names: every function the modules could define, and the inner ones."""
    part = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    more = table(spark, d, "region").select(F.explode(F.array(F.lit("method"), F.lit("bare"))).alias("name"))
    return part.union(more).distinct()


_C_ROWS = f"""{_modules('/classiq/', ROOT_C)},
rows AS (
  SELECT module || snake AS name, snake AS def, 'Makes ' || p_name || '. Really.' AS summary, p_type FROM mods
  UNION ALL SELECT module || 'method', 'method', 'Method. Doc.', p_type FROM mods)"""


@query("concept_extract_c", f"WITH {_C_ROWS} SELECT name, summary FROM rows")
def concept_extract_c(spark, d):
    """'bare' has no docstring, so not every name is found and both folders are read."""
    return code.extract_concepts(sdk_files(spark, d, ROOT_C), code.PROFILE_C, api_names(spark, d)).select(
        "name", "summary")


@query("concept_extract_c_stop", f"""WITH {_C_ROWS},
gap AS (SELECT count(*) AS n FROM (SELECT DISTINCT def FROM rows) WHERE def NOT IN (
  SELECT def FROM rows WHERE p_type <> 'STANDARD'))
SELECT name, summary FROM rows WHERE p_type <> 'STANDARD' OR (SELECT n FROM gap) > 0""")
def concept_extract_c_stop(spark, d):
    """All names are documented: the second folder is read only if the first leaves a gap."""
    names = api_names(spark, d).where(F.col("name") != "bare")
    return code.extract_concepts(sdk_files(spark, d, ROOT_C), code.PROFILE_C, names).select("name", "summary")


@query("public_api_gap", f"""SELECT {SQL_SNAKE} AS name, 'documented' AS status FROM part GROUP BY 1
UNION ALL SELECT 'method', 'documented' UNION ALL SELECT 'bare', 'missing'""")
def public_api_gap(spark, d):
    names = api_names(spark, d)
    found = code.extract_concepts(sdk_files(spark, d, ROOT_C), code.PROFILE_C, names)
    return code.api_gap(found, names)


@query("first_wins", """SELECT p_name, p_brand, p_partkey, p_size FROM part
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) = 1""")
def first_wins_query(spark, d):
    part = table(spark, d, "part").select("p_name", "p_brand", "p_partkey", "p_size")
    return first_wins(part, ["p_name"], [F.col("p_brand"), F.col("p_partkey")])


@query("row_numbers", """SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS "Row", doc_id, n_chars
FROM documents""")
def row_numbers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return numbered(docs, [F.desc("n_chars"), F.col("doc_id")], "Row")


# --- de-duplication -----------------------------------------------------------------------

def part_concepts(spark, d):
    """Classes and functions named after parts, unique by name: brands are modules."""
    kind = F.when(F.col("p_type").isin("ECONOMY", "SMALL", "LARGE"), "Class").otherwise("Function")
    part = table(spark, d, "part").select(
        "p_partkey", kind.alias("type"), F.col("p_name").alias("summary"),
        F.concat(F.lit("/fw/lib."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("."),
                 F.when(kind == "Class", camel(F.col("p_name")))
                 .otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))).alias("name"))
    return first_wins(part, ["name"], [F.col("p_partkey")])


_PARTS = f"""pc AS (SELECT * FROM (SELECT p_partkey, p_brand, p_name AS summary, {SQL_SNAKE} AS snake,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN 'Class' ELSE 'Function' END AS type, '/fw/lib.' ||
  lower(replace(p_brand, '#', '')) || '.' || CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN {SQL_CAMEL}
  ELSE {SQL_SNAKE} END AS name FROM part)
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY p_partkey) = 1)"""


@query("wrapper_antijoin", f"""WITH {_PARTS} SELECT p_partkey, type, summary, name FROM pc f
WHERE type = 'Class' OR NOT EXISTS (SELECT 1 FROM pc c WHERE c.type = 'Class' AND c.p_brand = f.p_brand
AND c.snake = f.snake)""")
def wrapper_antijoin(spark, d):
    return dedup.drop_wrappers(part_concepts(spark, d), "/fw/").select("p_partkey", "type", "summary", "name")


@query("wrapper_audit", f"""WITH {_PARTS} SELECT f.name AS removed, 'Wrapper for class ' || c.name AS reason,
f.summary FROM pc f JOIN pc c ON f.type = 'Function' AND c.type = 'Class' AND f.p_brand = c.p_brand
AND f.snake = c.snake""")
def wrapper_audit(spark, d):
    return dedup.wrapper_audit(part_concepts(spark, d), "/fw/")


def _greedy(source: str, threshold: float) -> str:
    """The sequential loop in SQL: one recursion step per row of ``source(ord, vec)``."""
    return f"""
nodes AS MATERIALIZED (SELECT ord, vec, row_number() OVER (ORDER BY ord) AS i FROM {source}),
near AS MATERIALIZED (SELECT a.i, list(b.i) AS js FROM nodes a JOIN nodes b ON b.i > a.i
  AND {sql_cosine('a.vec', 'b.vec')} > {threshold} GROUP BY 1),
steps AS (
  SELECT 0::BIGINT AS i, list_transform(range((SELECT count(*) FROM nodes)), lambda x: NULL::BIGINT) AS own
  UNION ALL
  SELECT s.i + 1, CASE WHEN s.own[s.i + 1] IS NOT NULL THEN s.own ELSE list_transform(s.own, lambda o, k:
    CASE WHEN k = s.i + 1 THEN s.i + 1 WHEN o IS NULL AND list_contains(coalesce(n.js, []), k) THEN s.i + 1
    ELSE o END) END
  FROM steps s LEFT JOIN near n ON n.i = s.i + 1 WHERE s.i < (SELECT count(*) FROM nodes)),
final AS (SELECT own FROM steps ORDER BY i DESC LIMIT 1),
clusters AS (SELECT a.ord, b.ord AS leader FROM nodes a, final f JOIN nodes b ON b.i = f.own[a.i])"""


@query("leader_clusters", f"WITH RECURSIVE {_VEC}, {_greedy('v', 0.35)} SELECT ord, leader FROM clusters")
def leader_clusters(spark, d):
    return clustering.leader_clusters(vectors(spark, d), 0.35)


def part_vectors(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), letter_profile(F.col("p_name")).alias("vec"))


@query("leader_clusters_copies", f"""WITH RECURSIVE
names AS (SELECT p_name, min(p_partkey) AS ord FROM part GROUP BY 1),
texts AS (SELECT ord, p_name, {sql_letter_profile('p_name')} AS vec FROM names), {_greedy('texts', 0.8)}
SELECT p.p_partkey AS ord, c.leader FROM part p JOIN names n USING (p_name) JOIN clusters c ON n.ord = c.ord""")
def leader_clusters_copies(spark, d):
    """Very many rows share few texts: copies collapse before anything is compared."""
    return clustering.leader_clusters(part_vectors(spark, d), 0.80)


def vector_concepts(spark, d):
    label = F.col("label")
    return vectors(spark, d).select(
        "ord", "vec", F.concat(F.lit("/fw/m.c"), "ord").alias("name"), F.concat(F.lit("sum "), "ord").alias("summary"),
        F.when(label < 5, "Class").otherwise("Function").alias("type"),
        F.when(label < 5, label == 2).alias("is_target_subclass"),
        F.when(label < 5, F.array(F.when(label == 4, "Gate").otherwise("object"))).alias("base_classes"),
        F.concat(F.when(label == 3, "Deprecated. ").otherwise(""), F.repeat(F.lit("x"), label)).alias("docstring"),
        F.when(label == 2, F.lit("@deprecate_func")).alias("source_code"))


_BEST = f"""{_greedy('v', 0.35)},
full_rows AS (SELECT c.ord, c.leader, v.label FROM clusters c JOIN v ON c.ord = v.ord),
best AS (SELECT * FROM full_rows QUALIFY row_number() OVER (PARTITION BY leader ORDER BY
  label NOT IN (2, 3) DESC, label = 2 DESC, label < 5 DESC, label = 4 DESC,
  CASE WHEN label = 3 THEN 15 ELSE label END DESC, ord) = 1)"""


@query("best_of_cluster", f"WITH RECURSIVE {_VEC}, {_BEST} SELECT leader AS cluster, '/fw/m.c' || ord AS name FROM best")
def best_of_cluster(spark, d):
    clusters = clustering.leader_clusters(vectors(spark, d), 0.35)
    rows = vector_concepts(spark, d).join(clusters.withColumnRenamed("leader", "cluster"), "ord")
    return dedup.best_of_cluster(rows).select("cluster", "name")


@query("semantic_dedup", f"""WITH RECURSIVE {_VEC}, {_BEST}
SELECT '/fw/m.c' || r.ord AS removed, '/fw/m.c' || b.ord AS kept, 'cluster' AS similarity,
'sum ' || r.ord AS removed_summary, 'sum ' || b.ord AS kept_summary
FROM full_rows r JOIN best b ON r.leader = b.leader WHERE r.ord <> b.ord""")
def semantic_dedup(spark, d):
    return dedup.semantic_dedup(vector_concepts(spark, d), 0.35)[1]


_MINED = f"""{_modules('/qiskit/', ROOT_A)},
kept AS (SELECT *, string_split('qiskit/circuit/library/' || CASE WHEN p_type = 'STANDARD' THEN ''
  ELSE lower(p_type) || '/' END || 'm' || p_partkey || '.py', '/') AS parts
  FROM mods WHERE p_type NOT IN ('PROMO', 'MEDIUM')),
found AS (
  SELECT parts, 0 AS pos, module || camel AS name, p_name || ' of ' || p_brand || '.' AS summary,
    length(p_name || ' of ' || p_brand || '..Size ' || p_size || '.') + 1 AS doc, p_size > 25 AS target, true AS class
  FROM kept
  UNION ALL SELECT parts, 1, module || 'Inner', 'Inner.', 6, false, true FROM kept
  UNION ALL SELECT parts, 2, module || 'inside', 'Inside.', 7, false, false FROM kept),
placed AS (SELECT *, row_number() OVER (ORDER BY parts, pos) - 1 AS ord, {sql_letter_profile('summary')} AS vec FROM found),
points AS (SELECT vec, min(ord) AS ord FROM placed GROUP BY 1), {_greedy('points', 0.95)},
ranked AS (SELECT f.name, f.summary, row_number() OVER (PARTITION BY c.leader
  ORDER BY target DESC, class DESC, target DESC, doc DESC, f.ord) AS place
  FROM placed f JOIN points p USING (vec) JOIN clusters c ON p.ord = c.ord)"""


@query("mined_concepts", f"WITH RECURSIVE {_MINED} SELECT name, summary FROM ranked WHERE place = 1")
def mined_concepts(spark, d):
    """Flow A from SDK files to unique concepts: extraction, wrappers, near copies."""
    kept, _ = pipeline.mine(sdk_files(spark, d, ROOT_A), code.PROFILE_A, letter_profile, 0.95)
    return kept.select("name", "summary")


@query("mined_concepts_b", f"SELECT name, summary FROM ({_B_SQL})")
def mined_concepts_b(spark, d):
    """Flow A of a framework whose concepts are its classes: no public names, near copies stay."""
    kept, _ = pipeline.mine(sdk_files(spark, d, ROOT_B), code.PROFILE_B)
    return kept.select("name", "summary")


@query("mined_concepts_c", f"WITH {_C_ROWS} SELECT name, summary FROM rows")
def mined_concepts_c(spark, d):
    """Flow A of a framework whose concepts are its public functions."""
    kept, _ = pipeline.mine(sdk_files(spark, d, ROOT_C), code.PROFILE_C, api_names=api_names(spark, d))
    return kept.select("name", "summary")


@query("vector_cosine", f"""WITH {_VEC} SELECT a.ord, round({_COS}, 4) AS cosine
FROM v a JOIN v b ON b.ord = a.ord + 1""")
def vector_cosine(spark, d):
    """Each vector with the one after it."""
    v = vectors(spark, d)
    after = v.select((F.col("ord") - 1).alias("ord"), F.col("vec").alias("next"))
    return v.join(after, "ord").select("ord", F.round(vx.cosine(F.col("vec"), F.col("next")), 4).alias("cosine"))


# --- repositories -------------------------------------------------------------------------

# not a month end and not midnight, so the calendar rule shows
AS_OF = dt.datetime(2002, 2, 28, 12, 0, tzinfo=dt.timezone.utc)


@query("repo_filter_reason", f"WITH {REPOS} SELECT full_name, reason FROM reasons")
def repo_filter_reason(spark, d):
    return repos.with_reason(repositories(spark, d), AS_OF).select("full_name", "reason")


@query("repo_topk", f"""WITH {REPOS} SELECT CAST(rank AS INTEGER) AS rank, full_name, stars AS stargazers_count,
coalesce(CAST(people AS VARCHAR), 'N/A') AS contributors_count,
strftime(pushed_at, '%Y-%m-%dT%H:%M:%SZ') AS pushed_at, description FROM ranked""")
def repo_topk(spark, d):
    out = repos.ranked_output(repos.ranked(repositories(spark, d), AS_OF))
    return out.drop("forks_count", "html_url")


@query("repo_verdicts", f"""WITH {REPOS} SELECT r.full_name, CASE WHEN r.reason IS NULL AND k.pos IS NULL
THEN 'Passed filters but not in top 200 by stars (' || r.stars || ' stars)' ELSE r.reason END AS reason
FROM reasons r LEFT JOIN ranked k ON r.pos = k.pos""")
def repo_verdicts(spark, d):
    return repos.verdicts(repositories(spark, d), AS_OF).select("full_name", "reason")


@query("repo_rejected", f"""WITH {REPOS} SELECT r.full_name, coalesce(r.reason,
'Passed filters but not in top 200 by stars (' || r.stars || ' stars)') AS reason
FROM reasons r WHERE r.pos NOT IN (SELECT pos FROM ranked)""")
def repo_rejected(spark, d):
    return repos.rejected(repos.verdicts(repositories(spark, d), AS_OF))


@query("funnel", f"""WITH {REPOS} SELECT (SELECT count(*) FROM reasons) AS candidates,
(SELECT count(*) FROM reasons) - (SELECT count(*) FROM ranked) AS filtered, (SELECT count(*) FROM ranked) AS final""")
def funnel(spark, d):
    return repos.funnel(repos.verdicts(repositories(spark, d), AS_OF))


@query("repo_dedup_first", f"""WITH {HARVEST} SELECT full_name, source_ord, pos, stargazers_count FROM harvest
QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY source_ord, pos) = 1""")
def repo_dedup_first(spark, d):
    return repos.candidates(repos_harvest(spark, d)).select("full_name", "source_ord", "pos", "stargazers_count")


@query("repo_search_cap", f"""WITH {HARVEST}, hits AS (SELECT * FROM harvest
QUALIFY source_ord <= 1 OR row_number() OVER (PARTITION BY source_ord ORDER BY pos) <= 200)
SELECT full_name, source_ord, pos, stargazers_count FROM hits
QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY source_ord, pos) = 1""")
def repo_search_cap(spark, d):
    """The first source is a known list, the others are queries with a limit."""
    found = repos.candidates(repos_harvest(spark, d), repos.SEARCH_CAP, known=1)
    return found.select("full_name", "source_ord", "pos", "stargazers_count")


@query("repo_dedup_last", f"""WITH {HARVEST} SELECT id, source_ord, pos, stargazers_count FROM harvest
QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_ord DESC, pos DESC) = 1""")
def repo_dedup_last(spark, d):
    return repos.latest_by_id(repos_harvest(spark, d)).select("id", "source_ord", "pos", "stargazers_count")


_SURVEY = f"""{HARVEST}, capped AS (SELECT * FROM harvest WHERE NOT fork AND stargazers_count >= 10
  QUALIFY row_number() OVER (PARTITION BY source_ord ORDER BY stargazers_count DESC, pos) <= 500),
survey AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_ord DESC, pos DESC) = 1)"""


@query("repo_survey", f"WITH {_SURVEY} SELECT id, source_ord, pos, language FROM survey")
def repo_survey(spark, d):
    return repos.survey(repos_harvest(spark, d)).select("id", "source_ord", "pos", "language")


_LANGS = """langs AS (SELECT coalesce(language, 'Unknown/Docs') AS language, count(*) AS repos FROM repos GROUP BY 1)"""


@query("language_dist", f"""WITH {REPOS}, {_LANGS} SELECT language, repos,
round(repos / (SELECT sum(repos) FROM langs) * 100, 6) AS percentage FROM langs""")
def language_dist(spark, d):
    out = repos.language_distribution(repositories(spark, d))
    return out.withColumn("percentage", F.round("percentage", 6))


@query("ranked_languages", f"""WITH {REPOS}, {_LANGS} SELECT row_number() OVER (ORDER BY repos DESC, language) AS "Rank",
language AS "Language", repos AS "Count",
printf('%.2f%%', repos / (SELECT sum(repos) FROM langs) * 100) AS "Percentage" FROM langs""")
def ranked_languages(spark, d):
    return repos.ranked_languages(repos.language_distribution(repositories(spark, d)))


@query("ecosystem_share", f"""WITH {REPOS}, {_LANGS}, s AS (
SELECT sum(repos) FILTER (language IN ('MACHINERY', 'BUILDING')) / sum(repos) * 100 AS e FROM langs)
SELECT round(e, 6) AS ecosystem, round(100 - e, 6) AS other FROM s""")
def ecosystem_share(spark, d):
    share = repos.ecosystem_share(repos.language_distribution(repositories(spark, d)), ["MACHINERY", "BUILDING"])
    return share.select(F.round("ecosystem", 6).alias("ecosystem"), F.round("other", 6).alias("other"))
