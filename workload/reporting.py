"""Report tables, coverage and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptmine.operators import agreement, coverage, lookup, stats
from workload.inputs import (
    BASE, DEFINED, FACTS, USES, WATCHED, base, defined_patterns, facts, table, uses, watched_patterns,
)

QUERIES = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def _counts(key: str) -> None:
    where = f"WHERE {key} IS NOT NULL"
    query(f"counts_by_{key}", f"WITH {FACTS} SELECT {key}, count(*) AS matches FROM facts {where} GROUP BY 1")(
        lambda spark, d: stats.counts_by(facts(spark, d), key))


for _key in ("match_type", "framework", "project", "pattern"):
    _counts(_key)


def _mean4(keys: str, where: str = "true") -> str:
    """Mean to four digits, ties to even, in exact integers."""
    return f"""WITH {FACTS}, g AS (SELECT {keys}, count(similarity_score) * 100000::HUGEINT AS unit,
  CAST(sum(CAST(similarity_score AS DECIMAL(18, 9))) * 1000000000 AS HUGEINT) AS total FROM facts WHERE {where} GROUP BY 1),
q AS (SELECT *, total // unit AS q, 2 * (total - total // unit * unit) AS rest FROM g)
SELECT {keys}, (q + CASE WHEN rest > unit OR (rest = unit AND q % 2 = 1) THEN 1 ELSE 0 END) / 10000 AS avg_score FROM q"""


@query("avg_by_match_type", _mean4("match_type"))
def avg_by_match_type(spark, d):
    return stats.mean_score_by(facts(spark, d), "match_type")


@query("avg_by_pattern", _mean4("pattern", "pattern IS NOT NULL"))
def avg_by_pattern(spark, d):
    return stats.mean_score_by(facts(spark, d), "pattern")


@query("overview", f"""WITH {FACTS} SELECT count(*) AS total_matches, count(DISTINCT file_path) AS files,
count(DISTINCT concept_name) AS concepts, round(coalesce(avg(CAST(similarity_score AS DECIMAL(18, 9))), 0), 6) AS avg_score FROM facts""")
def overview(spark, d):
    return stats.overview(facts(spark, d)).withColumn("avg_score", F.round("avg_score", 6))


@query("basic_stats", f"""WITH {FACTS}, {DEFINED} SELECT count(*) AS total_matches,
count(DISTINCT pattern) AS found_patterns, round(coalesce(avg(CAST(similarity_score AS DECIMAL(18, 9))), 0), 6) AS avg_score,
(SELECT count(*) FROM defined WHERE pattern NOT IN (SELECT pattern FROM facts WHERE pattern IS NOT NULL))
  AS unmatched_patterns FROM facts""")
def basic_stats(spark, d):
    out = stats.basic_statistics(facts(spark, d), defined_patterns(spark, d))
    return out.withColumn("avg_score", F.round("avg_score", 6))


@query("unmatched", f"""WITH {FACTS}, {DEFINED} SELECT pattern FROM defined
WHERE pattern NOT IN (SELECT pattern FROM facts WHERE pattern IS NOT NULL)""")
def unmatched(spark, d):
    return stats.unmatched_patterns(facts(spark, d), defined_patterns(spark, d))


@query("patterns_in_frameworks", f"""WITH {FACTS} SELECT framework, pattern, count(*) AS matches FROM facts
WHERE pattern IS NOT NULL GROUP BY 1, 2""")
def patterns_in_frameworks(spark, d):
    return stats.patterns_in_frameworks(facts(spark, d))


@query("source_table", f"""WITH {FACTS} SELECT pattern, count(*) AS total_matches,
array_to_string(list_sort(list(DISTINCT framework)), ', ') AS source_framework_names
FROM facts WHERE pattern IS NOT NULL GROUP BY 1""")
def source_table(spark, d):
    return stats.source_table(facts(spark, d))


@query("adoption_table", f"""WITH {FACTS} SELECT pattern, count(similarity_score) AS total_matches,
count(DISTINCT project) AS target_project_coverage,
array_to_string(list_sort(list(DISTINCT project)), ', ') AS target_project_names
FROM facts WHERE pattern IS NOT NULL GROUP BY 1""")
def adoption_table(spark, d):
    return stats.adoption_table(facts(spark, d))


@query("top_concepts", f"""WITH {FACTS}, top AS (
SELECT concept_name, count(*) AS n FROM facts GROUP BY 1 ORDER BY n DESC, concept_name LIMIT 20)
SELECT DISTINCT concept_name, upper(framework[1]) || lower(framework[2:]) AS "Framework",
'...' || split_part(replace(concept_name, '/', '.'), '.', -1) AS "Concept", n AS "Matches"
FROM top JOIN facts USING (concept_name)""")
def top_concepts(spark, d):
    return stats.top_concepts(facts(spark, d))


@query("concept_counts", f"""WITH {FACTS} SELECT framework, concept_name, count(*) AS matches FROM facts
GROUP BY 1, 2""")
def concept_counts(spark, d):
    return stats.concept_counts(facts(spark, d))


@query("top_framework_concepts", f"""WITH {FACTS} SELECT framework AS "Framework", concept_name AS "Concept",
count(*) AS "Matches" FROM facts GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def top_framework_concepts(spark, d):
    return stats.top_framework_concepts(facts(spark, d))


@query("watchlist", f"""WITH {FACTS}, {WATCHED} SELECT w.pattern, count(f.pattern) AS matches
FROM watched w LEFT JOIN facts f ON w.pattern = f.pattern GROUP BY 1""")
def watchlist(spark, d):
    return stats.watch_list(facts(spark, d), watched_patterns(spark, d))


@query("watch_summary", f"""WITH {FACTS}, {WATCHED} SELECT
count(*) FILTER (pattern IN (SELECT pattern FROM facts WHERE pattern IS NOT NULL)) AS found,
count(*) AS watched FROM watched""")
def watch_summary(spark, d):
    return stats.watch_summary(facts(spark, d), watched_patterns(spark, d))


@query("found_watched", f"""WITH {FACTS}, {WATCHED} SELECT pattern FROM watched
INTERSECT SELECT pattern FROM facts""")
def found_watched(spark, d):
    return stats.found_watched(facts(spark, d), watched_patterns(spark, d))


# --- coverage ---------------------------------------------------------------------

FOUND = "found AS (SELECT DISTINCT framework, pattern FROM uses WHERE pattern <> '')"


@query("coverage_pct", f"""WITH {USES}, {BASE}, {FOUND}, c AS (
SELECT count(*) FILTER (pattern IN (SELECT pattern FROM found)) AS covered, count(*) AS base FROM base)
SELECT covered, base, round(covered / base * 100, 6) AS coverage_pct FROM c""")
def coverage_pct(spark, d):
    return coverage.coverage(uses(spark, d), base(spark, d)).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("framework_coverage", f"""WITH {USES}, {BASE}, {FOUND}, c AS (
SELECT u.framework, count(b.pattern) AS covered, (SELECT count(*) FROM base) AS base
FROM (SELECT DISTINCT framework FROM uses) u LEFT JOIN found f ON u.framework = f.framework
LEFT JOIN base b ON f.pattern = b.pattern GROUP BY 1)
SELECT framework, covered, base, round(covered / base * 100, 6) AS coverage_pct FROM c""")
def framework_coverage(spark, d):
    out = coverage.framework_coverage(uses(spark, d), base(spark, d))
    return out.withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("pattern_counts", f"WITH {USES}, {FOUND} SELECT framework, count(*) AS patterns FROM found GROUP BY 1")
def pattern_counts(spark, d):
    return coverage.pattern_counts(uses(spark, d))


@query("missing_extra", f"""WITH {USES}, {BASE}, {FOUND}
SELECT pattern, 'missing' AS status FROM base WHERE pattern NOT IN (SELECT pattern FROM found)
UNION ALL SELECT DISTINCT pattern, 'extra' FROM found WHERE pattern NOT IN (SELECT pattern FROM base)""")
def missing_extra(spark, d):
    return coverage.missing_and_extra(uses(spark, d), base(spark, d))


@query("all_patterns", f"WITH {USES}, {FOUND} SELECT DISTINCT pattern FROM found")
def all_patterns(spark, d):
    return coverage.all_patterns(uses(spark, d))


@query("pattern_sources", f"""WITH {USES}, c AS (SELECT DISTINCT framework, pattern, name FROM uses WHERE pattern <> ''),
g AS (SELECT framework, pattern, count(*) AS concepts, list_sort(list(name)) AS names FROM c GROUP BY 1, 2)
SELECT framework, pattern, concepts,
array_to_string(list_transform(names[1:3], lambda x: split_part(x, '/', -1)), ', ')
|| CASE WHEN concepts > 3 THEN ' (+' || (concepts - 3) || ' more)' ELSE '' END AS examples FROM g""")
def pattern_sources(spark, d):
    return coverage.pattern_sources(uses(spark, d))


@query("extra_pattern_sources", f"""WITH {USES}, {BASE},
c AS (SELECT DISTINCT framework, pattern, name FROM uses WHERE pattern <> ''
      AND pattern NOT IN (SELECT pattern FROM base))
SELECT pattern, framework, count(*) OVER (PARTITION BY pattern, framework) AS concepts,
split_part(name, '/', -1) AS concept FROM c""")
def extra_pattern_sources(spark, d):
    return coverage.extra_pattern_sources(uses(spark, d), base(spark, d))


# the fixed brands of the part table stand for the fixed list of frameworks
MATRIX_OF = [f"Brand#{i}" for i in range(1, 26)]


@query("coverage_matrix", f"WITH {USES}, {FOUND} SELECT pattern, " + ", ".join(
    f"CAST(count(*) FILTER (framework = '{b}') AS INTEGER) AS \"{b}\"" for b in MATRIX_OF)
    + ", CAST(count(*) AS INTEGER) AS frameworks FROM found GROUP BY 1")
def coverage_matrix(spark, d):
    return coverage.coverage_matrix(uses(spark, d), MATRIX_OF)


@query("common_to_three", f"""WITH {USES}, {FOUND} SELECT pattern FROM found
WHERE framework IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1 HAVING count(*) = 3""")
def common_to_three(spark, d):
    matrix = coverage.coverage_matrix(uses(spark, d), MATRIX_OF)
    return coverage.common_patterns(matrix, ["Brand#1", "Brand#2", "Brand#3"])


@query("pairwise_common", f"""WITH {USES}, {FOUND} SELECT a.framework AS framework_a, b.framework AS framework_b,
count(*) AS common FROM found a JOIN found b ON a.pattern = b.pattern AND a.framework < b.framework GROUP BY 1, 2""")
def pairwise_common(spark, d):
    return coverage.pairwise_common(uses(spark, d))


@query("only_in_frameworks", f"""WITH {USES}, {FACTS}, {FOUND} SELECT DISTINCT pattern FROM found
WHERE pattern NOT IN (SELECT pattern FROM facts WHERE pattern IS NOT NULL)""")
def only_in_frameworks(spark, d):
    return coverage.only_in(uses(spark, d), stats.with_pattern(facts(spark, d)))


# --- agreement ----------------------------------------------------------------------

RATERS = ["r1", "r2", "r3"]


def ratings(spark, d):
    """Three raters per document: its quality label, its length, and its toxicity turned round."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return table(spark, d, "labels").join(docs, "doc_id", "right").select(
        "doc_id", F.concat(F.lit(" "), F.col("quality").cast("string")).alias("r1"),
        F.when(F.col("n_chars") > 1500, "1 ").when(F.col("n_chars") > 300, "0").otherwise("2").alias("r2"),
        (1 - F.col("toxic")).cast("string").alias("r3"))


RATINGS = """
ratings AS (SELECT doc_id, CAST(quality AS VARCHAR) AS r1,
  CASE WHEN n_chars > 1500 THEN '1' WHEN n_chars > 300 THEN '0' ELSE '2' END AS r2,
  CAST(1 - toxic AS VARCHAR) AS r3 FROM labels JOIN documents USING (doc_id)),
votes AS (SELECT doc_id AS item, unnest([r1, r2, r3]) AS category FROM ratings),
matrix AS (SELECT item, category, count(*) AS n FROM votes GROUP BY 1, 2)
"""
PAIRS = """
pairs AS (SELECT unnest([{'pair': 'r1 vs r2', 'a': r1, 'b': r2}, {'pair': 'r1 vs r3', 'a': r1, 'b': r3},
  {'pair': 'r2 vs r3', 'a': r2, 'b': r3}], recursive := true) FROM ratings),
po AS (SELECT pair, avg(CAST(a = b AS INTEGER)) AS po, count(*) AS n FROM pairs GROUP BY 1),
pa AS (SELECT pair, a AS c, count(*) AS n FROM pairs GROUP BY 1, 2),
pb AS (SELECT pair, b AS c, count(*) AS n FROM pairs GROUP BY 1, 2),
pe AS (SELECT pair, sum(pa.n * pb.n) AS s FROM pa JOIN pb USING (pair, c) GROUP BY 1),
kappas AS (SELECT pair, (po - s / (n * n)) / (1 - s / (n * n)) AS kappa FROM po JOIN pe USING (pair))
"""


@query("rating_counts", f"WITH {RATINGS} SELECT * FROM matrix")
def rating_counts(spark, d):
    return agreement.count_matrix(ratings(spark, d), "doc_id", RATERS)


@query("fleiss_kappa", f"""WITH {RATINGS},
p AS (SELECT item, (sum(n * n) - 3) / 6 AS p FROM matrix GROUP BY 1),
q AS (SELECT category, sum(n) / (SELECT sum(n) FROM matrix) AS q FROM matrix GROUP BY 1),
v AS (SELECT (SELECT avg(p) FROM p) AS po, (SELECT sum(q * q) FROM q) AS pe)
SELECT round((po - pe) / (1 - pe), 8) AS kappa FROM v""")
def fleiss_kappa(spark, d):
    return agreement.fleiss_kappa(ratings(spark, d), RATERS).withColumn("kappa", F.round("kappa", 8))


@query("cohen_kappa", f"WITH {RATINGS}, {PAIRS} SELECT pair, round(kappa, 8) AS kappa FROM kappas")
def cohen_kappa(spark, d):
    return agreement.cohen_kappas(ratings(spark, d), RATERS).withColumn("kappa", F.round("kappa", 8))


@query("lights_kappa", f"""WITH {RATINGS}, {PAIRS}, m AS (SELECT avg(kappa) AS kappa FROM kappas)
SELECT round(kappa, 8) AS kappa, CASE WHEN kappa < 0 THEN 'Poor agreement' WHEN kappa <= 0.2 THEN 'Slight agreement'
WHEN kappa <= 0.4 THEN 'Fair agreement' WHEN kappa <= 0.6 THEN 'Moderate agreement'
WHEN kappa <= 0.8 THEN 'Substantial agreement' ELSE 'Almost perfect agreement' END AS interpretation FROM m""")
def lights_kappa(spark, d):
    return agreement.lights_kappa(ratings(spark, d), RATERS).withColumn("kappa", F.round("kappa", 8))


# --- knowledge base -----------------------------------------------------------------

def concepts(spark, d):
    part = table(spark, d, "part")
    short = F.concat_ws("_", F.lower("p_type"), F.replace("p_name", F.lit(" "), F.lit("_")), "p_size")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("/"), "p_brand", F.lit("/lib."), short).alias("name"), F.col("p_name").alias("summary"))


def knowledge_base(spark, d):
    """Keys of all kinds: full names, names of another module, and bare endings."""
    part = table(spark, d, "part")
    words = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), "p_size")
    kind = F.col("p_type")
    key = (
        F.when(kind == "ECONOMY", F.concat(F.lit("/"), "p_brand", F.lit("/lib.economy_"), words))
        .when(kind == "SMALL", F.concat(F.lit("/kb/x.small_"), words))
        .when(kind == "LARGE", F.concat(F.lit("arge_"), words))
        .otherwise(words))
    return part.select(
        F.lower("p_brand").alias("framework"), F.when(kind == "PROMO", 1).otherwise(0).alias("file_no"),
        F.col("p_partkey").alias("ord"), key.alias("name"), F.col("p_name").alias("summary"),
        F.when(F.col("p_size") == 50, "").when(F.col("p_size") == 49, "N/A").otherwise(
            F.concat_ws("-", "p_brand", "p_type")).alias("pattern"))


KB = """
concepts AS (SELECT p_partkey AS id, p_name AS summary,
  '/' || p_brand || '/lib.' || lower(p_type) || '_' || replace(p_name, ' ', '_') || '_' || p_size AS name,
  lower(p_type) || '_' || replace(p_name, ' ', '_') || '_' || p_size AS short_name FROM part),
kb AS (SELECT lower(p_brand) AS framework, p_name AS summary,
  CASE p_type WHEN 'ECONOMY' THEN '/' || p_brand || '/lib.economy_' WHEN 'SMALL' THEN '/kb/x.small_'
    WHEN 'LARGE' THEN 'arge_' ELSE '' END || replace(p_name, ' ', '_') || '_' || p_size AS name,
  CASE p_size WHEN 50 THEN '' WHEN 49 THEN 'N/A' ELSE p_brand || '-' || p_type END AS pattern,
  [CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END, p_partkey] AS place FROM part),
keys AS (SELECT name, max_by(pattern, place) AS pattern, min(place) AS pos FROM kb WHERE pattern <> '' GROUP BY 1),
shorts AS (SELECT split_part(split_part(name, '/', -1), '.', -1) AS short_name, max_by(pattern, pos) AS pattern
  FROM keys GROUP BY 1),
ends AS (SELECT c.name, min_by(k.pattern, k.pos) AS pattern FROM (SELECT DISTINCT name FROM concepts) c
  JOIN keys k ON ends_with(c.name, k.name) GROUP BY 1),
resolved AS (SELECT c.id, c.name, c.short_name, c.summary, nullif(coalesce(f.pattern, s.pattern, e.pattern), 'N/A') AS pattern,
  CASE WHEN f.pattern IS NOT NULL THEN 'full' WHEN s.pattern IS NOT NULL THEN 'short'
    WHEN e.pattern IS NOT NULL THEN 'suffix' ELSE 'none' END AS tier
  FROM concepts c LEFT JOIN keys f ON c.name = f.name LEFT JOIN shorts s ON c.short_name = s.short_name
  LEFT JOIN ends e ON c.name = e.name)
"""


def resolved(spark, d):
    return lookup.resolve_patterns(concepts(spark, d), lookup.pattern_map(knowledge_base(spark, d)))


@query("lookup_tiers", f"WITH {KB} SELECT id, name, short_name, summary, pattern, tier FROM resolved")
def lookup_tiers(spark, d):
    return resolved(spark, d)


@query("pattern_map", f"WITH {KB} SELECT name, pattern, pos[1] AS file_no, pos[2] AS ord FROM keys")
def pattern_map(spark, d):
    return lookup.pattern_map(knowledge_base(spark, d)).select(
        "name", "pattern", F.col("pos.file_no").cast("bigint").alias("file_no"), F.col("pos.ord").alias("ord"))


@query("unclassified", f"WITH {KB} SELECT name, summary FROM resolved WHERE pattern IS NULL")
def unclassified(spark, d):
    return lookup.unclassified(resolved(spark, d))


@query("mapping_summary", f"WITH {KB} SELECT count(pattern) AS resolved, count(*) AS total FROM resolved")
def mapping_summary(spark, d):
    return lookup.mapping_summary(resolved(spark, d))


@query("kb_consolidate", f"WITH {KB} SELECT framework, name, summary, pattern FROM kb")
def kb_consolidate(spark, d):
    return lookup.consolidate(knowledge_base(spark, d))


@query("pattern_list", f"WITH {KB} SELECT DISTINCT pattern FROM kb WHERE pattern <> ''")
def pattern_list(spark, d):
    from conceptmine.sources.tables import pattern_names
    return pattern_names(knowledge_base(spark, d))
