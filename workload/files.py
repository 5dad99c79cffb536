"""Sources and sinks: derived tables are written to files and read back."""

from __future__ import annotations

import os
import shutil

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from conceptmine.operators import coverage, repos, stats
from conceptmine.session import scratch
from conceptmine.sinks import export
from conceptmine.sources import catalogue, scan, tables
from workload import mining, reporting, texts
from workload.inputs import BASE, DEFINED, FACTS, REPOS, WATCHED, as_stored, defined_patterns, facts, repositories, table, watched_patterns

QUERIES = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def put(rows, path: str | None = None, form: str = "csv", **options) -> str:
    """Write plain files for a reader to find."""
    path = path or scratch(rows.sparkSession)
    rows.write.mode("append").options(**options).format(form).save(path)
    return path


def one_file_each(rows, by: list[str] | None = None) -> str:
    """Text files with one value each.

    Those of a task get folders of their own below ``by``, listed side by side. On a disk tasks write them themselves:
    Spark's writer takes some 15 ms of a core a file there.
    """
    path = scratch(rows.sparkSession)
    local = scan.local_path(rows.sparkSession, path)
    if by and local is not None:
        _write_local(rows, by, local)
        return path
    if by:
        rows, by = rows.withColumn("_task", F.spark_partition_id()), [*by, "_task"]
    rows.write.options(**PLAIN_FILES).option("maxRecordsPerFile", 1).partitionBy(*by or []).text(path)
    return path


# Local files without checksum files; other file systems do not look at this.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
# Characters that Spark's writer escapes in the name of a folder.
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *b"\"#%'*/:=?\\{[]^"]}


def _write_local(rows, by: list[str], root: str) -> None:
    """What Spark's text writer does, ``by`` folders included. A task's folders appear when all its files are written."""
    value, = (c for c in rows.columns if c not in by)

    def write(batches):
        context = TaskContext.get()
        task, own = context.partitionId(), f"{root}/.{context.taskAttemptId()}"
        folders, files = {}, 0
        for batch in batches:
            *keys, values = (c.to_pylist() for c in batch.columns)
            for *key, content in zip(*keys, values):
                folder = folders.get(key := tuple(key))
                if folder is None:
                    folder = folders[key] = "/".join(
                        f"{c}={k.translate(_ESCAPED) if k else '__HIVE_DEFAULT_PARTITION__'}" for c, k in zip(by, key))
                    os.makedirs(f"{own}/{folder}", exist_ok=True)
                with open(f"{own}/{folder}/part-{files:09d}.txt", "wb") as file:
                    file.write((content or b"") + b"\n")
                files += 1
        for folder in set(folders.values()):
            os.makedirs(f"{root}/{folder}", exist_ok=True)
            try:
                os.rename(f"{own}/{folder}", f"{root}/{folder}/_task={task}")
            except OSError:
                if not os.path.isdir(f"{root}/{folder}/_task={task}"):
                    raise  # else an earlier run of this task has put its files there
        shutil.rmtree(own, ignore_errors=True)
        yield pa.RecordBatch.from_arrays([pa.array([files])], ["files"])

    os.makedirs(root, exist_ok=True)
    plain = rows.select(*[F.col(c).cast("string") for c in by], F.col(value).cast("binary"))
    plain.mapInArrow(write, "files long").agg(F.sum("files")).collect()


QUOTED = {"quote": '"', "escape": '"', "header": "true", "emptyValue": ""}

# --- match table ----------------------------------------------------------------------------

_MATCHED = f"""{FACTS}, matched AS (SELECT *, framework || ' said "' || match_type || ';' || chr(10) || project || '"' AS matched_text FROM facts)"""


def matched_facts(spark, d):
    """Match rows whose text has quotes, separators and line ends."""
    text = F.concat("framework", F.lit(' said "'), "match_type", F.lit(";\n"), "project", F.lit('"'))
    return facts(spark, d).withColumn("matched_text", text)


_BACK = f"""WITH {_MATCHED} SELECT file_path, concept_name, pattern, match_type, matched_text,
similarity_score::DOUBLE AS similarity_score, framework, project FROM matched"""


@query("match_table_text", _BACK)
def match_table_text(spark, d):
    path = scratch(spark)
    export.write_matches(matched_facts(spark, d), f"{path}/table", f"{path}/text")
    return tables.read_matches(spark, f"{path}/text")


@query("match_table_parquet", _BACK)
def match_table_parquet(spark, d):
    path = scratch(spark)
    export.write_matches(matched_facts(spark, d).drop("framework", "project"), path)
    return tables.read_match_table(spark, path)


# --- concepts ---------------------------------------------------------------------------------

def concept_rows(spark, d):
    """One concept per part; some lack a summary or a source."""
    return table(spark, d, "part").select(
        F.concat(F.lit("/"), "p_brand", F.lit("/lib."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("._x/"), "p_partkey").alias("name"),
        F.when(F.col("p_size") > 2, F.concat("p_name", F.lit(', a "'), "p_type", F.lit('"\nof; '), "p_brand")).alias("summary"),
        F.concat("p_name", F.lit(".\n\nMore.")).alias("docstring"),
        F.when(F.col("p_size") != 9, F.concat(F.lit("def f():\n    return "), "p_size")).otherwise("").alias("source_code"),
        F.lit("Class").alias("type"), (F.col("p_size") > 20).alias("is_target_subclass"),
        F.array("p_brand", F.lit("Gate")).alias("base_classes"))


_CONCEPTS = """concepts AS (SELECT '/' || p_brand || '/lib.' || replace(p_name, ' ', '_') || '._x/' || p_partkey AS name,
  CASE WHEN p_size > 2 THEN p_name || ', a "' || p_type || '"' || chr(10) || 'of; ' || p_brand END AS summary,
  p_name || '.' || chr(10) || chr(10) || 'More.' AS docstring,
  CASE WHEN p_size <> 9 THEN 'def f():' || chr(10) || '    return ' || p_size ELSE '' END AS source_code,
  'Class' AS type, p_size > 20 AS is_target_subclass, [p_brand, 'Gate'] AS base_classes, p_brand, p_partkey FROM part)"""


@query("concepts_json_lines", f"""WITH {_CONCEPTS} SELECT name, summary, docstring, NULL::VARCHAR AS source_code, type, is_target_subclass,
base_classes FROM concepts WHERE summary IS NOT NULL""")
def concepts_json_lines(spark, d):
    path = scratch(spark)
    export.write_concepts_json(concept_rows(spark, d), path)
    return tables.read_concepts_json(spark, [path, scratch(spark)], lines=True)


@query("concepts_json_arrays", f"WITH {_CONCEPTS} SELECT name, summary, source_code FROM concepts WHERE summary IS NOT NULL")
def concepts_json_arrays(spark, d):
    """Files of one JSON array each."""
    rows = concept_rows(spark, d).withColumn("_file", F.regexp_extract("name", r"(\d)$", 1))
    arrays = rows.groupBy("_file", F.crc32("name") % 50).agg(F.to_json(F.collect_list(F.struct("name", "summary", "source_code"))).alias("value"))
    return tables.read_concepts_json(spark, [one_file_each(arrays.select("value"))]).select("name", "summary", "source_code")


@query("concepts_csv", f"""WITH {_CONCEPTS} SELECT CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS framework, name, summary FROM concepts""")
def concepts_csv(spark, d):
    """Two frameworks with delimiters of their own; an empty summary comes back as null."""
    rows, path = concept_rows(spark, d), scratch(spark)
    even = F.regexp_extract("name", r"(\d)$", 1).cast("int") % 2 == 0
    export.write_concepts_csv(rows.where(even), f"{path}/even", ";")
    export.write_concepts_csv(rows.where(~even), f"{path}/odd", ",")
    return tables.read_concepts_csv(spark, {"even": (f"{path}/even", ";"), "odd": (f"{path}/odd", ","), "none": (f"{path}/none", ",")})


@query("snippet_table", f"""WITH {_CONCEPTS} SELECT p_brand AS framework,
  ltrim(replace(replace(name, '/', '_'), '.', '_'), '_') AS snippet_key, source_code FROM concepts WHERE source_code <> ''""")
def snippet_table(spark, d):
    path = scratch(spark)
    export.write_snippets(concept_rows(spark, d), path)
    return spark.read.schema("snippet_key string, source_code string, framework string").parquet(path)


@query("unclassified_table", f"WITH {reporting.KB} SELECT name, summary FROM resolved WHERE pattern IS NULL")
def unclassified_table(spark, d):
    path = scratch(spark)
    export.write_unclassified(reporting.resolved(spark, d), path)
    return spark.read.schema("name string, summary string").options(**QUOTED).csv(path)


# --- knowledge base and lists -------------------------------------------------------------------

@query("pattern_name_file", f'WITH {reporting.KB} SELECT DISTINCT pattern FROM kb WHERE pattern <> \'\'')
def pattern_name_file(spark, d):
    path = scratch(spark)
    export.write_pattern_list(tables.pattern_names(reporting.knowledge_base(spark, d)), path)
    return tables.read_pattern_list(spark, path)


@query("kb_pattern_column", f"WITH {reporting.KB} SELECT DISTINCT pattern FROM kb WHERE pattern <> ''")
def kb_pattern_column(spark, d):
    """The consolidated knowledge base, then its pattern column by name."""
    path = scratch(spark)
    export.write_knowledge_base(reporting.knowledge_base(spark, d), path)
    return tables.read_pattern_column(spark, path)


@query("kb_files", f"""WITH {reporting.KB} SELECT framework, name, summary, pattern, (framework = 'brand#2')::INT AS file_no
FROM kb WHERE pattern <> '' AND framework IN ('brand#1', 'brand#2')""")
def kb_files(spark, d):
    """A knowledge-base file each for two frameworks, and one that is missing; a row without a pattern has too few fields."""
    kb, path = reporting.knowledge_base(spark, d), scratch(spark)
    files = {}
    for framework in ("brand#1", "brand#2"):
        files[framework] = put(kb.where(F.col("framework") == framework).select("name", "summary", F.nullif("pattern", F.lit("")).alias("pattern")),
                               f"{path}/{framework.replace('#', '')}", **QUOTED)
    rows = tables.read_knowledge_base(spark, files | {"none": f"{path}/none"})
    return rows.drop("ord")


@query("line_list", "SELECT 'org/c' || c_custkey AS value FROM customer WHERE c_nationkey <> 3")
def line_list(spark, d):
    """Names with blanks around them, and blank lines."""
    name = F.when(F.col("c_nationkey") != 3, F.concat(F.lit(" \torg/c"), "c_custkey", F.lit("  "))).otherwise(" ")
    path = put(table(spark, d, "customer").select(name.alias("value")), form="text")
    return tables.read_lines(spark, path)


@query("newest_file", "SELECT c_name AS value FROM customer WHERE c_nationkey >= 20")
def newest_file(spark, d):
    """Two files, one after the other; the last one written is read."""
    rows, path = table(spark, d, "customer"), scratch(spark)
    for part in (rows.where("c_nationkey < 20"), rows.where("c_nationkey >= 20")):
        put(part.select("c_name").coalesce(1), path, form="text")
    return spark.read.text(tables.latest_file(spark, path, "*.txt"))


@query("ratings_file", f"WITH {reporting.RATINGS} SELECT r1, r2, r3 FROM ratings")
def ratings_file(spark, d):
    rows = reporting.ratings(spark, d).where("r1 IS NOT NULL AND r3 IS NOT NULL")
    path = put(rows.select("r1", "r2", "r3"), ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **QUOTED)
    return tables.read_ratings(spark, path, reporting.RATERS).select(*[F.trim(r).alias(r) for r in reporting.RATERS])


@query("catalogue_file", """SELECT url AS name, 'Does "' || url || '"' AS intent, NULL::VARCHAR AS alias, page_id::VARCHAR AS context,
NULL::VARCHAR AS forces, NULL::VARCHAR AS solution, 'a' || chr(10) || 'b' AS result FROM pages""")
def catalogue_file(spark, d):
    """Files of one JSON array each."""
    entry = F.struct(F.col("url").alias("name"), F.concat(F.lit('Does "'), "url", F.lit('"')).alias("intent"),
                     F.col("page_id").cast("string").alias("context"), F.lit("a\nb").alias("result"))
    arrays = table(spark, d, "pages").groupBy(F.col("page_id") % 40).agg(F.to_json(F.collect_list(entry)).alias("value"))
    return tables.read_catalogue(spark, one_file_each(arrays.select("value")))


# --- repositories -----------------------------------------------------------------------------------

@query("repository_file", f"""WITH {REPOS} SELECT id, full_name, description, stars AS stargazers_count, people AS contributors_count,
  strftime(pushed_at, '%Y-%m-%d') AS pushed, c_nationkey = 5 AS archived, c_nationkey = 6 AS fork, language FROM repos""")
def repository_file(spark, d):
    path = put(repositories(spark, d), form="json")
    return tables.read_repositories(spark, path).select(
        "id", "full_name", "description", "stargazers_count", "contributors_count",
        F.date_format("pushed_at", "yyyy-MM-dd").alias("pushed"), "archived", "fork", "language")


@query("repository_list", f"""WITH {REPOS} SELECT 'ranked' AS kind, rank::BIGINT AS rank, full_name, stars FROM ranked
UNION ALL SELECT 'names', NULL, full_name, NULL FROM ranked""")
def repository_list(spark, d):
    path = scratch(spark)
    export.write_repositories(repos.ranked(repositories(spark, d), mining.AS_OF), path)
    ranked = spark.read.schema("rank long, full_name string, stargazers_count long").json(f"{path}/ranked")
    names = tables.read_lines(spark, f"{path}/names")
    none = F.lit(None).cast("long")
    return ranked.select(F.lit("ranked").alias("kind"), "rank", "full_name", F.col("stargazers_count").alias("stars")).unionByName(
        names.select(F.lit("names").alias("kind"), none.alias("rank"), F.col("value").alias("full_name"), none.alias("stars")))


@query("language_json_file", f"""WITH {REPOS}, {mining._LANGS} SELECT (SELECT sum(repos) FROM langs)::BIGINT AS total_repos,
'2024-01-01' AS timestamp, language, repos FROM langs""")
def language_json_file(spark, d):
    path = scratch(spark)
    export.write_language_json(repos.language_distribution(repositories(spark, d)), path, ["q1", "q2"], "2024-01-01")
    return tables.read_language_distribution(spark, path)


@query("language_csv_file", f"""WITH {REPOS}, {mining._LANGS} SELECT (row_number() OVER (ORDER BY repos DESC, language))::INT AS "Rank",
language AS "Language", repos AS "Count", printf('%.2f%%', repos / (SELECT sum(repos) FROM langs) * 100) AS "Percentage" FROM langs""")
def language_csv_file(spark, d):
    path = scratch(spark)
    export.write_languages(repos.language_distribution(repositories(spark, d)), path)
    return spark.read.schema("Rank int, Language string, Count long, Percentage string").options(**QUOTED).csv(path)


# --- file scans --------------------------------------------------------------------------------------

@query("script_scan", "SELECT 'lang=' || lang AS project, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) AS text FROM documents")
def script_scan(spark, d):
    """Every document as a script file of its own, by language."""
    path = one_file_each(as_stored(spark, d, "documents").select("lang", "text"), ["lang"])
    return scan.scan_scripts(spark, path, glob="*.txt").select("project", "text")


@query("notebook_scan", """SELECT 'source=' || source AS project, count(*) AS notebooks FROM documents GROUP BY 1""")
def notebook_scan(spark, d):
    """Every document as a notebook file of its own, counted by folder; those in a skipped folder are left out."""
    rows = texts.notebook_files(spark, d, as_stored).select(F.split("path", "/")[0].alias("source"), F.col("text").alias("value"))
    found = scan.scan_notebooks(spark, one_file_each(rows, ["source"]), ["none"], glob="*.txt")
    return scan.notebook_counts(found.where(F.col("text") != ""))


# --- report bundle -----------------------------------------------------------------------------------

@query("report_bundle", f"""WITH {FACTS}, {DEFINED}, {WATCHED}
SELECT 'patterns_in_frameworks' AS name, lower(framework) || ' ' || pattern AS key, count(*)::VARCHAR AS value FROM facts
WHERE pattern IS NOT NULL GROUP BY framework, pattern
UNION ALL SELECT 'matches_by_project', project, count(*)::VARCHAR FROM facts GROUP BY project
UNION ALL SELECT 'source_pattern_analysis', pattern, count(*) || ' ' || array_to_string(list_sort(list(DISTINCT framework)), ', ') FROM facts
WHERE pattern IS NOT NULL GROUP BY pattern
UNION ALL SELECT 'adoption_pattern_analysis', pattern, count(DISTINCT project) || ' ' || array_to_string(list_sort(list(DISTINCT project)), ', ')
FROM facts WHERE pattern IS NOT NULL GROUP BY pattern
UNION ALL SELECT 'newly_defined_patterns_occurrence', w.pattern, count(f.pattern)::VARCHAR FROM watched w LEFT JOIN facts f USING (pattern) GROUP BY 1, 2
UNION ALL SELECT 'unmatched_patterns', pattern, '' FROM defined WHERE pattern NOT IN (SELECT pattern FROM facts WHERE pattern IS NOT NULL)""")
def report_bundle(spark, d):
    """Six of the written tables, read back."""
    path = scratch(spark)
    written = export.write_report(facts(spark, d), defined_patterns(spark, d), watched_patterns(spark, d), path)

    def back(name: str, columns: str, key, value):
        rows = spark.read.schema(columns).options(**QUOTED).csv(f"{path}/{name}")
        return rows.select(F.lit(name).alias("name"), key.alias("key"), value.alias("value")).where(F.lit(name in written))

    parts = [
        back("patterns_in_frameworks", "pattern string, count string, framework string", F.concat_ws(" ", "framework", "pattern"), F.col("count")),
        back("matches_by_project", "project string, count string", F.col("project"), F.col("count")),
        back("source_pattern_analysis", "p string, n string, names string", F.col("p"), F.concat_ws(" ", "n", "names")),
        back("adoption_pattern_analysis", "p string, n string, names string", F.col("p"), F.concat_ws(" ", "n", "names")),
        back("newly_defined_patterns_occurrence", "p string, n string", F.col("p"), F.col("n")),
        back("unmatched_patterns", "p string", F.col("p"), F.lit("")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
