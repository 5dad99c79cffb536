"""Inputs the queries share, derived row by row or by key from the given tables.

Every frame has a SQL twin (a common table expression) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conceptmine.functions import text as tx
from conceptmine.session import spread
from conceptmine.sources.tables import with_origin

WS = tx.SPACE_CHARS.replace("'", "''")
WS_CLASS = "[" + WS.replace("\\", "\\\\") + "]"


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the footer once, later reads start no job for it."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are expensive to work on. The given tables can be one file with one row group."""
    return spread(table(spark, sf_dir, name), spark.sparkContext.defaultParallelism)


def as_stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table like ``wide``, dealt out only if it is stored in fewer pieces than there are cores: dealing leaves a copy on disk."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    return rows if len(files) >= cores or row_groups(spark, files) >= cores else spread(rows, cores)


def row_groups(spark: SparkSession, files: list[str]) -> int:
    jvm, found = spark._jvm, 0
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark._jsparkSession.sessionState().newHadoopConf()))
        found += footer.getRowGroups().size()
        footer.close()
    return found


def sql_strip(c: str) -> str:
    return f"trim({c}, '{WS}')"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS_CLASS}+', ' ', 'g'))"


# --- match facts ----------------------------------------------------------------

def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rows: one per line item, concept = part, file = nation of the supplier and order."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_discount")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    home = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        home, F.col("l_suppkey") == F.col("s_suppkey"))
    pattern = F.when(F.col("p_size") > 40, "N/A").when(F.col("p_size") > 1, F.concat_ws("-", "p_type", "p_size"))
    return with_origin(rows.select(
        F.concat("n_name", F.lit("/o"), "l_orderkey", F.lit(".py")).alias("file_path"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("."), "p_name").alias("concept_name"),
        pattern.alias("pattern"), F.col("l_returnflag").alias("match_type"),
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_discount").cast("string")).alias(
            "similarity_score"),
    ))


FACTS = """
facts AS (
  SELECT n_name || '/o' || l_orderkey || '.py' AS file_path,
         '/' || p_brand || '/' || p_type || '.' || p_name AS concept_name,
         CASE WHEN p_size BETWEEN 2 AND 40 THEN p_type || '-' || p_size END AS pattern,
         l_returnflag AS match_type,
         CASE WHEN l_linenumber <> 7 THEN l_discount END AS similarity_score,
         p_brand AS framework, n_name AS project
  FROM lineitem JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""


def defined_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns a knowledge base would define: every type and size of a part, and one per brand."""
    part = table(spark, sf_dir, "part")
    sized = part.select(F.concat_ws("-", "p_type", F.col("p_size") + 5).alias("pattern"))
    return sized.union(part.select(F.col("p_brand").alias("pattern"))).distinct()


DEFINED = """
defined AS (SELECT p_type || '-' || (p_size + 5) AS pattern FROM part UNION SELECT p_brand FROM part)
"""


def watched_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watch list from the suppliers: some names never match."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("SMALL-"), F.col("s_nationkey") * 3).alias("pattern")).distinct()


WATCHED = "watched AS (SELECT DISTINCT 'SMALL-' || (s_nationkey * 3) AS pattern FROM supplier)"

# --- labelled concepts ------------------------------------------------------------


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("framework"),
        F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("."), "p_name").alias("name"),
        F.when(F.col("p_size") > 1, F.concat(F.lit(" "), "p_type", F.lit("-"), "p_size")).otherwise(" ").alias("pattern"))


USES = """
uses AS (SELECT p_brand AS framework, '/' || p_brand || '/' || p_type || '.' || p_name AS name,
                CASE WHEN p_size > 1 THEN p_type || '-' || p_size ELSE '' END AS pattern FROM part)
"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.concat_ws("-", "p_type", F.col("p_size") + 25).alias("pattern")).distinct()


BASE = "base AS (SELECT DISTINCT p_type || '-' || (p_size + 25) AS pattern FROM part)"

# --- vectors ------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"), "label")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_profile(c):
    """A caller-supplied encoder made of built-in expressions: letter counts of the text."""
    letters = F.array(*[F.lit(ch) for ch in LETTERS])
    # the one-element array binds the lower-cased text once for all letters
    counts = F.transform(F.array(F.lower(c)), lambda low: F.transform(
        letters, lambda ch: F.length(low) - F.length(F.replace(low, ch, F.lit("")))))
    return F.element_at(counts, 1).cast("array<float>")


def sql_letter_profile(c: str) -> str:
    letters = ", ".join(f"'{ch}'" for ch in LETTERS)
    return f"list_transform([{letters}], lambda ch: length(lower({c})) - length(replace(lower({c}), ch, '')))::DOUBLE[]"


def sql_cosine(a: str, b: str) -> str:
    def dot(x, y):
        return f"list_dot_product({x}, {y})"
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


# --- scripts, modules, notebooks ------------------------------------------------------

def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small script per event; 'error' events do not parse."""
    ok = F.concat(F.lit("import api\nr = api."), "event_type", F.lit("(helper("), "event_id",
                  F.lit("), key='"), "user_id", F.lit("').done()\ntable[0](1)\n"))
    return wide(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id", F.lit("/e"), "event_id", F.lit(".py")).alias("path"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("def broken(:\n    call("), "event_id", F.lit(")")))
        .otherwise(ok).alias("text"))


def camel(c):
    return F.replace(F.initcap(c), F.lit(" "), F.lit(""))


SQL_CAMEL = (
    "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')"
)
SQL_SNAKE = "replace(p_name, ' ', '_')"


def repos_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits: one per order, the query is the order's priority, the repository its customer."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("source_ord"), F.col("o_orderkey").alias("pos"),
        F.col("o_custkey").alias("id"), F.concat(F.lit("org/c"), "o_custkey").alias("full_name"),
        F.floor("o_totalprice").alias("stargazers_count"), (F.col("o_orderstatus") == "F").alias("fork"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("language"))


HARVEST = """
harvest AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS source_ord, o_orderkey AS pos, o_custkey AS id,
         'org/c' || o_custkey AS full_name, CAST(floor(o_totalprice) AS BIGINT) AS stargazers_count,
         o_orderstatus = 'F' AS fork, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS language
  FROM orders)
"""


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository per customer with orders: stars, age and contributors from its orders."""
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.max("o_orderdate").alias("pushed_at"))
    joined = table(spark, sf_dir, "customer").join(totals, F.col("c_custkey") == F.col("o_custkey"))
    unknown = F.col("c_nationkey").isin(3, 4)
    return joined.select(
        F.lit(0).alias("source_ord"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") == 11, F.concat(F.lit("Org/Awesome-List-"), "c_custkey"))
        .otherwise(F.concat(F.lit("Org/Repo"), "c_custkey")).alias("full_name"),
        F.when(F.col("c_nationkey") != 12, F.concat(F.lit("About "), F.lower("c_mktsegment"), F.when(
            F.col("c_nationkey") == 13, F.lit(" Books")).otherwise(""))).alias("description"),
        F.array(F.initcap("c_mktsegment"), F.when(F.col("c_nationkey") == 14, F.lit("Books")).otherwise("code"))
        .alias("topics"),
        (F.col("n") * 8).alias("stargazers_count"), F.col("n").alias("forks_count"),
        F.when(~unknown, F.col("n") + 1).alias("contributors_count"),
        F.when(F.col("c_nationkey") == 4, 403).alias("contributors_status"), "pushed_at",
        (F.col("c_nationkey") == 5).alias("archived"), (F.col("c_nationkey") == 6).alias("fork"),
        F.when(F.col("c_nationkey") != 7, F.col("c_mktsegment")).alias("language"),
        F.concat(F.lit("https://host.example/"), "c_custkey").alias("html_url"))


REPOS = """
repos AS (
  SELECT c_custkey AS pos, c_custkey AS id,
    CASE WHEN c_nationkey = 11 THEN 'Org/Awesome-List-' ELSE 'Org/Repo' END || c_custkey AS full_name,
    CASE WHEN c_nationkey <> 12 THEN 'About ' || lower(c_mktsegment) ||
      CASE WHEN c_nationkey = 13 THEN ' Books' ELSE '' END END AS description,
    c_nationkey, n * 8 AS stars, CASE WHEN c_nationkey NOT IN (3, 4) THEN n + 1 END AS people, pushed_at,
    CASE WHEN c_nationkey <> 7 THEN c_mktsegment END AS language
  FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS pushed_at FROM orders GROUP BY 1)
    ON c_custkey = o_custkey),
reasons AS (
  SELECT *, CASE
    WHEN c_nationkey = 5 THEN 'Archived repository'
    WHEN c_nationkey = 6 THEN 'Is a fork'
    WHEN stars < 30 THEN 'Not enough stars (' || stars || ' < 30)'
    WHEN pushed_at < TIMESTAMP '2002-02-28 12:00:00' - INTERVAL 12 MONTH
      THEN 'Inactive since ' || strftime(pushed_at, '%Y-%m-%d')
    WHEN contains(lower(full_name) || ' ' || coalesce(lower(description), ''), 'awesome-list')
      THEN 'Excluded by Keyword ''awesome-list'' in name/description'
    WHEN contains(lower(full_name) || ' ' || coalesce(lower(description), ''), 'books')
      THEN 'Excluded by Keyword ''books'' in name/description'
    WHEN c_nationkey = 14 THEN 'Excluded by Topic ''books'''
    WHEN c_nationkey = 4 THEN 'Could not fetch contributors due to API limits (403)'
    WHEN people < 10 THEN 'Not enough contributors (' || people || ' < 10)' END AS reason
  FROM repos),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY stars DESC, pos) AS rank FROM reasons
  WHERE reason IS NULL QUALIFY rank <= 200)
"""
