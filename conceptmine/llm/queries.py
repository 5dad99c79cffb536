"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from conceptmine.llm import (
    decontaminate, licenses, line_rules, ngram_join, packing, prefix_trie, sharding, simhash, style_tree, suffix_dedup, toxicity,
    vector_codes, weak_quality,
)

QUERIES = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = [f"shard-{i:03d}" for i in range(128)]


@query("op4_sharding", f"""
    WITH filled AS (SELECT unnest(string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',')) AS s,
                           generate_subscripts(string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ','), 1) - 1 AS slot),
    placed AS (SELECT doc_id, ('0x' || substr(md5('k' || coalesce(':' || doc_id, '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot
               FROM documents)
    SELECT doc_id, slot::INT AS slot, 'shard-' || lpad(s, 3, '0') AS shard FROM placed JOIN filled USING (slot)""")
def op4(spark, d):
    return sharding.place(table(spark, d, "documents").select("doc_id"), "doc_id", SHARDS)


@query("op7_decontamination")
def op7(spark, d):
    report = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


@query("op9_quality_rules")
def op9(spark, d):
    report = line_rules.quality_report(table(spark, d, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "n_words_left", F.size("drop_lines").cast("long").alias("n_lines_removed"))


@query("op3_ngram_jaccard_join")
def op3(spark, d):
    return ngram_join.similar_groups(table(spark, d, "documents")).drop("text_hash", "kept")


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_best_fit_packing")
def op6(spark, d):
    return packing.pack(table(spark, d, "documents"), vocabulary())


@query("op10_suffix_array_dedup")
def op10(spark, d):
    """One row per removed span: words [begin, end) of the document repeat a passage that first_doc_id has."""
    found = suffix_dedup.repeated_spans(table(spark, d, "documents"))
    return found.select("doc_id", F.explode("spans").alias("s")).select(
        "doc_id", "s.begin", "s.end", (F.col("s.end") - F.col("s.begin")).alias("n_words"), F.col("s.first_doc").alias("first_doc_id"))


@query("op8_html_extraction")
def op8(spark, d):
    return style_tree.main_text(table(spark, d, "pages"))


@query("op5_toxicity")
def op5(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels")))


@query("op2_quality_classifier")
def op2(spark, d):
    docs = table(spark, d, "documents")
    return weak_quality.score(docs, weak_quality.fit(docs))


@query("op1_license_scan")
def op1(spark, d):
    return licenses.scan(table(spark, d, "documents"))


def _codes_sql(parts: int = 16, width: int = 4, entries: int = 64, rounds: int = 2) -> str:
    """All distances of all parts to all entries, ``rounds`` times and once more; ``width`` components a part."""
    x, c = [f"x{i}" for i in range(width)], [f"c{i}" for i in range(width)]
    apart = " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(x, c))
    moved = ", ".join(f"CASE WHEN n IS NULL THEN {b} ELSE (s{i} - ((s{i} % n) + n) % n) // n END AS {b}" for i, b in enumerate(c))
    sql = f"""
    WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor({vector_codes.SCALE} * v::DOUBLE)::BIGINT) AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    parts AS (SELECT vec_id, p, {", ".join(f"v[{width} * p + {i + 1}] AS {a}" for i, a in enumerate(x))} FROM kept, range({parts}) t(p)),
    book0 AS (SELECT p, i, {", ".join(f"{a} AS {b}" for a, b in zip(x, c))} FROM parts JOIN
              (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM kept QUALIFY i < {entries}) USING (vec_id))"""
    for r in range(rounds + 1):
        sql += f""",
    near{r} AS (SELECT vec_id, p, min(({apart}) * 1000 + i) AS m FROM parts JOIN book{r} USING (p) GROUP BY vec_id, p),
    sums{r} AS (SELECT p, m % 1000 AS i, count(*) AS n, {", ".join(f"sum({a})::BIGINT AS s{i}" for i, a in enumerate(x))}
                FROM near{r} JOIN parts USING (vec_id, p) GROUP BY p, m % 1000),
    book{r + 1} AS (SELECT p, i, {moved} FROM book{r} LEFT JOIN sums{r} USING (p, i))"""
    return sql + f""",
    coded AS (SELECT vec_id, string_agg(printf('%02x', m % 1000), '' ORDER BY p) AS code, sum(m // 1000)::BIGINT AS error
              FROM near{rounds} GROUP BY vec_id)
    SELECT vec_id, code, error, label, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(concat_ws(',', {", ".join(c)}), ',' ORDER BY p, i)) FROM book{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""


@query("op12_vector_codes", _codes_sql())
def op12(spark, d):
    return vector_codes.compress(table(spark, d, "embeddings"))


@query("op11_simhash_near_dedup")
def op11(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


# crc32 of a decimal number: the usual table, built by shifts, then byte by byte
_CRC_TABLE = """(SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"""


@query("op13_prefix_trie", f"""
    WITH crc AS (SELECT {_CRC_TABLE} AS t),
    convs AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
    heads AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295::UBIGINT, list_reduce(
                  [4294967295::UBIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT),
                  lambda a, b: xor(a >> 8, t[((xor(a, b) & 255) + 1)::BIGINT]))) % 6 AS h FROM convs, crc),
    own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS v
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    seqs AS (SELECT h.conv_id, coalesce(b.v[1:h.h], []) || o.v[h.h + 1:] AS s
             FROM heads h JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = h.base),
    members AS (SELECT conv_id, s[1:d] AS p, s, d FROM seqs, LATERAL (SELECT unnest(range(len(s) + 1)) AS d)),
    nodes AS (SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d > 0 THEN (count(*) - 1) * length(p[d].t) ELSE 0 END AS saved,
              sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
              FROM members GROUP BY p, d),
    children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    below AS (SELECT n.p[1:a.d] AS p, count(*) FILTER (c.n IS NULL) AS n_leaves, sum(n.saved)::BIGINT AS saved_tokens
              FROM nodes n LEFT JOIN children c USING (p), LATERAL (SELECT unnest(range(n.depth + 1)) AS d) a GROUP BY 1)
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
    FROM nodes n JOIN below b USING (p) LEFT JOIN children c USING (p) LEFT JOIN nodes u ON n.depth > 0 AND u.p = n.p[1:n.depth - 1]""")
def op13(spark, d):
    return prefix_trie.prefix_trie(table(spark, d, "conversations"))
