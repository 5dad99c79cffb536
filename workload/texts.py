"""Scalar text functions, notebooks, HTML, catalogue and scan bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.operators.html import html_text
from conceptmine.sources import catalogue, notebooks, scan
from workload.inputs import SQL_CAMEL, WS_CLASS, camel, sql_squeeze, sql_strip, table, wide

QUERIES = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def _scalar(name: str, source: str, key: str, expr, sql_expr: str, prefix: str = "") -> None:
    """A query that applies one text function to every row of a table."""
    query(name, f"{prefix} SELECT {key}, {sql_expr} AS out FROM {source}")(
        lambda spark, d: (wide if source in ("documents", "pages") else table)(spark, d, source).select(
            key, expr().alias("out")))


# --- names and paths ------------------------------------------------------------------

_scalar("short_name", "pages", "page_id", lambda: tx.short_name(F.col("url")),
        "split_part(split_part(url, '/', -1), '.', -1)")


def _blankish():
    return F.when(F.col("lang") == "de", " ").otherwise(F.concat(F.lit("//"), "source", F.lit("/"), "lang", F.lit("/")))


_scalar("framework_of", "documents", "doc_id", lambda: tx.framework_of(_blankish()),
        "CASE WHEN lang = 'de' THEN 'unknown' ELSE source END")
_scalar("project_of", "documents", "doc_id",
        lambda: tx.project_of(F.when(F.col("lang") == "de", F.concat(F.lit("/"), "source"))
                              .when(F.col("lang") == "fr", F.lit(None))
                              .otherwise(F.concat(F.lit("./"), "source", F.lit("//x.py")))),
        "CASE lang WHEN 'de' THEN '/' WHEN 'fr' THEN '' ELSE source END")
_scalar("display_name", "pages", "page_id", lambda: tx.display_name(F.col("url")),
        "'...' || split_part(replace(url, '/', '.'), '.', -1)")
_scalar("dotted_name", "pages", "page_id", lambda: tx.dotted_name(F.col("url")), "replace(url, '/', '.')")
_scalar("capitalize", "documents", "doc_id", lambda: tx.capitalize(F.col("text")),
        "upper(text[1]) || lower(text[2:])")
_scalar("snake_case", "part", "p_partkey", lambda: tx.snake_case(F.concat(F.lit("RY"), camel(F.col("p_name")), F.lit("2X"))),
        "'ry_' || replace(p_name, ' ', '_') || '2_x'")
_scalar("camel_words", "part", "p_partkey", lambda: camel(F.col("p_name")), SQL_CAMEL)
_scalar("module_path", "pages", "page_id", lambda: tx.module_path(F.col("url")),
        "replace(regexp_replace(url, '([^/])\\.[^./]+$', '\\1'), '/', '.')")
_scalar("module_of_concept", "part", "p_partkey",
        lambda: tx.module_of_concept(F.concat(F.lit("/fw/"), F.lower("p_type"), F.lit("."), "p_brand", F.lit("."), "p_name"), "/fw/"),
        "lower(p_type) || '.' || p_brand")
_scalar("snippet_key", "pages", "page_id", lambda: tx.snippet_key(F.concat(F.lit("//"), "url"), True),
        "ltrim(translate('//' || url, '/.', '__'), '_')")
_scalar("snippet_key_one", "pages", "page_id", lambda: tx.snippet_key(F.concat(F.lit("//"), "url"), False),
        "substr(translate('//' || url, '/.', '__'), 2)")
_scalar("repo_folder", "customer", "c_custkey",
        lambda: tx.repo_folder(F.when(F.col("c_nationkey") == 1, "tensorflow/quantum").otherwise(
            F.concat_ws("/", "c_mktsegment", "c_name"))),
        "CASE WHEN c_nationkey = 1 THEN 'tensorflow-quantum' ELSE c_name END")
_scalar("archive_path", "documents", "doc_id",
        lambda: tx.archive_path(F.concat_ws("/", F.lit(""), "source", "lang", F.lit("")), F.concat("doc_id", F.lit("/n.ipynb"))),
        "source || '_' || lang || '/' || doc_id || '/n.ipynb'")
_scalar("score_text", "documents", "doc_id", lambda: tx.score_text(F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") / 512).otherwise(
            F.col("n_chars") / 20000)),
        "printf('%.4f', n_chars / CASE WHEN doc_id % 2 = 0 THEN 512 ELSE 20000 END)")

# --- prose ------------------------------------------------------------------------------


def _script():
    lines = F.replace("text", F.lit("\n"), F.lit("\r\n  ## "))
    return F.concat(F.lit("x = 1  # trailing\n#!head\n#\n"), lines, F.lit("\n\t#  last "))


_scalar("comments", "documents", "doc_id", lambda: tx.comment_block(_script()),
        "array_to_string([y FOR y IN [" + sql_strip("ltrim(" + sql_strip("x") + ", '# ')")
        + " FOR x IN string_split_regex('x = 1  # trailing' || chr(10) || '#!head' || chr(10) || '#' || chr(10) ||"
        " replace(text, chr(10), chr(13) || chr(10) || '  ## ') || chr(10) || chr(9) || '#  last ', '[\\r\\n]+')"
        " IF starts_with(" + sql_strip("x") + ", '#')] IF y <> ''], ' ')")
_scalar("truncate", "documents", "doc_id", lambda: tx.truncated_comment(F.replace("text", F.lit(","), F.lit(";"))),
        "replace(CASE WHEN length(text) > 150 THEN replace(text, ',', ';')[1:150] || '...'"
        " ELSE replace(text, ',', ';') END, ';', ',')")
_scalar("preview", "documents", "doc_id", lambda: tx.preview(F.when(F.col("lang") != "de", F.col("text"))),
        "CASE WHEN lang = 'de' THEN 'N/A' WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END")


def _docstring():
    return F.concat(F.lit(" \n"), F.replace("text", F.lit(".\n"), F.lit(".\n\n")), F.lit("\n \n x"))


_PARA = "string_split(" + sql_strip("' ' || chr(10) || replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) "
                                    "|| chr(10) || ' ' || chr(10) || ' x'") + ", chr(10) || chr(10))[1]"
_scalar("first_paragraph", "documents", "doc_id", lambda: tx.first_paragraph(_docstring()),
        f"replace({sql_strip(_PARA)}, chr(10), ' ')")
_SENTENCES = "[y FOR y IN [" + sql_strip("x") + " FOR x IN string_split(" + sql_squeeze("para") + ", '.')] IF y <> '']"
_scalar("two_sentence_summary", "documents", "doc_id", lambda: tx.two_sentences(_docstring()),
        "(SELECT CASE WHEN len(s) > 0 THEN array_to_string(s[1:2], '. ') || '.' ELSE para END FROM "
        f"(SELECT para, {_SENTENCES} AS s FROM (SELECT {_PARA} AS para)))")
_scalar("boilerplate", "documents", "doc_id",
        lambda: tx.without_boilerplate(F.concat(
            F.lit("\n[Qmod core-library function]. "),
            F.replace("text", F.lit("\n"), F.lit(" [Qmod Classiq-library function]\n")))),
        sql_strip("regexp_replace(regexp_replace(chr(10) || '[Qmod core-library function]. ' || replace(text, chr(10),"
                  " ' [Qmod Classiq-library function]' || chr(10)),"
                  f" '{WS_CLASS}*\\[Qmod Classiq-library function\\]\\.?{WS_CLASS}*', ' ', 'g'),"
                  f" '{WS_CLASS}*\\[Qmod core-library function\\]\\.?{WS_CLASS}*', ' ', 'g')"))
_scalar("md_escape", "documents", "doc_id",
        lambda: tx.markdown_row(F.concat(F.lit(" a|"), "source"), F.replace("text", F.lit(","), F.lit("|"))),
        "'| `a\\|' || source || '` | ' || " + sql_squeeze("replace(replace(text, ',', '|'), '|', '\\|')") + " || ' |'")
_LATEX = "text || '\\{}&%$#_~^'"
for _plain, _escaped in tx.LATEX_ESCAPES:
    _LATEX = f"replace({_LATEX}, '{_plain}', '{_escaped}')"
_scalar("latex_escape", "documents", "doc_id", lambda: tx.latex_escape(F.concat("text", F.lit("\\{}&%$#_~^"))), _LATEX)


@query("pattern_section", """SELECT doc_id, array_to_string([x FOR x IN [
  '## ' || source || chr(10),
  CASE WHEN lang NOT IN ('de', 'fr') THEN '***Also known as:** ' || lang || '*' || chr(10) END,
  '### Intent' || chr(10) || chr(10) || trim(text, '""" + tx.SPACE_CHARS + """') || chr(10),
  CASE WHEN n_chars > 900 THEN '### Solution' || chr(10) || chr(10) || 'long' || chr(10) END,
  '### Resulting Context' || chr(10) || chr(10) || lang || chr(10)] IF x IS NOT NULL], chr(10)) AS out
FROM documents""")
def pattern_section(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("name"), F.col("text").alias("intent"),
        F.when(F.col("lang") == "de", "— ").when(F.col("lang") != "fr", F.col("lang")).alias("alias"),
        F.lit("").alias("context"), F.lit(None).cast("string").alias("forces"),
        F.when(F.col("n_chars") > 900, " long").alias("solution"), F.col("lang").alias("result"))
    return docs.select("doc_id", tx.pattern_markdown().alias("out"))


# --- notebooks ------------------------------------------------------------------------------

def notebook_files(spark, d, read=wide):
    """One notebook per document: its lines are prose cells, each followed by a code cell; German ones are broken."""
    lines = F.split("text", "\n")
    prose = F.transform(lines, lambda x: F.struct(
        F.lit("markdown").alias("cell_type"), F.array(F.lit("Part\n"), x).alias("source"),
        F.lit(None).cast("int").alias("execution_count")))
    code = F.transform(lines, lambda x, i: F.struct(
        F.lit("code").alias("cell_type"),
        F.array(F.lit("%time run(1)\n"), F.concat(F.lit("size("), F.length(x), F.lit(")"))).alias("source"),
        i.alias("execution_count")))
    cells = F.flatten(F.zip_with(prose, code, lambda p, c: F.array(p, c)))
    good = F.to_json(F.struct(cells.alias("cells")))
    return read(spark, d, "documents").select(
        "doc_id", F.concat("source", F.lit("/d"), "doc_id", F.lit(".ipynb")).alias("path"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(secs=F.col("n_chars"))).alias("modified"),
        F.when(F.col("lang") == "de", F.lit("{broken")).otherwise(good).alias("text"))


def manifest(spark, d):
    """Scripts written so far: those of the labelled documents, all at one moment."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return docs.select(
        F.concat("source", F.lit("/d"), "doc_id", F.lit(".py")).alias("path"),
        F.lit("2024-01-01 00:20:00").cast("timestamp").alias("converted"))


_CELLS = """array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
  chr(10) || '# Part' || chr(10) || '# ' || x || chr(10) ||
  chr(10) || '# In[' || CASE WHEN i > 1 THEN CAST(i - 1 AS VARCHAR) ELSE ' ' END || ']:' || repeat(chr(10), 3) ||
  'get_ipython().run_line_magic(''time'', ''run(1)'')' || chr(10) || 'size(' || length(x) || ')' ||
  repeat(chr(10), 2)), '')"""


@query("notebook_to_script", f"""SELECT doc_id, source || '/d' || doc_id || '.py' AS path,
CASE WHEN lang <> 'de' THEN '#!/usr/bin/env python' || chr(10) || '# coding: utf-8' || chr(10) || {_CELLS} END AS text
FROM documents""")
def notebook_to_script(spark, d):
    return notebooks.convert(notebook_files(spark, d)).select("doc_id", "path", "text")


_STATUS = """status AS (SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NOT NULL AND n_chars <= 1200 THEN 'SKIPPED'
  WHEN lang = 'de' THEN 'ERROR' ELSE 'SUCCESS' END AS status
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("incremental_status", f"WITH {_STATUS} SELECT doc_id, status FROM status")
def incremental_status(spark, d):
    return notebooks.conversion_status(notebook_files(spark, d), manifest(spark, d)).select("doc_id", "status")


@query("pending_notebooks", f"WITH {_STATUS} SELECT doc_id FROM status WHERE status <> 'SKIPPED'")
def pending_notebooks(spark, d):
    return notebooks.pending(notebook_files(spark, d), manifest(spark, d)).select("doc_id")


@query("status_counts", f"""WITH {_STATUS} SELECT count(*) FILTER (status = 'SUCCESS') AS success,
count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'ERROR') AS error FROM status""")
def status_counts(spark, d):
    return notebooks.status_counts(notebooks.conversion_status(notebook_files(spark, d), manifest(spark, d)))


@query("notebook_counts", "SELECT source AS project, count(*) AS notebooks FROM documents GROUP BY 1")
def notebook_counts(spark, d):
    return scan.notebook_counts(notebook_files(spark, d))


@query("projects", "SELECT DISTINCT source AS project FROM documents")
def projects(spark, d):
    return scan.projects(notebook_files(spark, d))


# --- HTML and catalogue ---------------------------------------------------------------------

_NODES = """string_split_regex(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '<x>', 'gs'), '<[^>]*>')"""
_ENTITIES = [("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"),
             ("&middot;", "·"), ("&mdash;", "—"), ("&eacute;", "é"), ("&amp;", "&"), ("&amp", "&")]
_DECODED = "x"
for _name, _char in _ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_name}', '{_char}')"
_HTML_TEXT = f"array_to_string([y FOR y IN [{sql_strip(_DECODED)} FOR x IN {_NODES}] IF y <> ''], ' ')"
_scalar("html_text", "pages", "page_id", lambda: html_text(F.col("html")), _HTML_TEXT)


@query("catalogue_entries", """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS language_id
FROM customer WHERE c_nationkey <> 3 AND c_acctbal >= 0""")
def catalogue_entries(spark, d):
    """One listing answer per customer; some entries lack a name or an id."""
    model = F.struct(
        F.when(F.col("c_nationkey") != 3, F.col("c_custkey").cast("string")).otherwise("").alias("id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("patternLanguageId"))
    answer = F.to_json(F.struct(F.struct(F.array(model).alias("patternModels")).alias("_embedded")))
    return catalogue.entries(table(spark, d, "customer").select(answer.alias("json")))


@query("catalogue_details", f"""SELECT url AS name, {_HTML_TEXT} AS intent, 'Not available' AS alias,
url || ' x' AS context, 'Not available' AS forces, 'Not available' AS solution, 'Not available' AS result
FROM pages WHERE html <> ''""")
def catalogue_details(spark, d):
    """One answer per page with two sections in HTML."""
    content = F.create_map(F.lit("Intent"), F.col("html"),
                           F.lit("Context"), F.concat(F.lit("<p> "), "url", F.lit("</p><b>x</b>")))
    answer = F.to_json(F.struct(content.alias("renderedContent")))
    return catalogue.details(wide(spark, d, "pages").select(F.col("url").alias("name"), answer.alias("json")))
