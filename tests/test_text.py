"""Scalar text functions against fixed values and against plain Python."""

import random
import re

from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.operators.code import drop_doc_blocks
from conceptmine.operators.html import plain_text


def test_short_name(apply):
    assert apply(tx.short_name, ["lib/circuit/Circuit", "", None, "/a/b.c.d", "a/"]) == ["Circuit", "", "", "d", ""]


def test_framework(apply):
    got = apply(tx.framework_of, ["fw/circuit", "/fw/x", "", "  ", None, "invalid", "///"])
    assert got == ["fw", "fw", "unknown", "unknown", "unknown", "invalid", ""]


def test_project(apply):
    got = apply(tx.project_of, ["p2/sub/f.py", None, "", "./a/b", "/a", "//a/b", "///a", "a//b", "."])
    assert got == ["p2", "", "", "a", "/", "//", "/", "a", "."]


def test_comment_block_matches_line_rule(apply):
    def plain(text):
        found = []
        for line in re.split(r"\r\n|\r|\n", text):
            s = line.strip()
            if s.startswith("#") and s.lstrip("# ").strip():
                found.append(s.lstrip("# ").strip())
        return " ".join(found)

    rng = random.Random(1)
    texts = ["".join(rng.choice(["#", " ", "\n", "\r\n", "\t", "a", "é", "\xa0", "\u2003", "x = 1"]) for _ in range(80))
             for _ in range(60)] + ["", "#", "#!/bin/sh\n# coding: x\nx = 1 # no"]
    assert apply(tx.comment_block, texts) == [plain(t) for t in texts]


def test_truncation_keeps_short_text(apply):
    assert apply(tx.truncated_comment, ["a;b", "x" * 150, "x" * 149 + ";y"]) == [
        "a,b", "x" * 150, "x" * 149 + ",..."]


def test_snake_case(apply):
    got = apply(tx.snake_case, ["CamelCase", "HTTPServer", "RYGate2X", "already_snake", "QFT"])
    assert got == ["camel_case", "http_server", "ry_gate2_x", "already_snake", "qft"]


def test_two_sentences(apply):
    got = apply(tx.two_sentences, [
        "First sentence. Second sentence. Third sentence.", "No period", "", None, "...", " \n A.\n\nB.",
        "First paragraph.\n        \n        Second paragraph.", "  One.   Two.  "])
    assert got == ["First sentence. Second sentence.", "No period.", "", "", "...", "A.",
                   "First paragraph. Second paragraph.", "One. Two."]


def test_first_paragraph(apply):
    assert apply(tx.first_paragraph, [" a\nb\n\nc", "one"]) == ["a b", "one"]


def test_boilerplate(apply):
    got = apply(tx.without_boilerplate, ["[Qmod core-library function]", "[Qmod Classiq-library function].\n\nText.", "A b"])
    assert got == ["", "Text.", "A b"]


def test_latex_braces_of_backslash_are_escaped(apply):
    assert apply(tx.latex_escape, ["a_b\\", "50% ~ {x}"]) == [
        r"a\_b\textbackslash\{\}", r"50\% \textasciitilde{} \{x\}"]


def test_markdown_row(spark):
    df = spark.createDataFrame([("a|b", "x\n  y | z"), (None, None)], "n string, s string")
    got = [r[0] for r in df.select(tx.markdown_row(F.col("n"), F.col("s"))).collect()]
    assert got == ["| `a\\|b` | x y \\| z |", "| `N/A` |  |"]


def test_pattern_markdown_skips_empty_parts(spark):
    schema = "name string, alias string, intent string, context string, forces string, solution string, result string"
    df = spark.createDataFrame([("P", " — ", "why ", "", None, None, "end"), (None, "Q", None, None, None, None, None)], schema)
    got = [r[0] for r in df.select(tx.pattern_markdown()).collect()]
    assert got[0] == "## P\n\n### Intent\n\nwhy\n\n### Resulting Context\n\nend\n"
    assert got[1] == "## Unnamed Pattern\n\n***Also known as:** Q*\n"


def test_small_ones(apply):
    assert apply(tx.display_name, ["/a/b.C"]) == ["...C"]
    names = ["pENNY lane", "ßa", "ǆA", "ﬁN", "", "éT"]
    assert apply(tx.capitalize, names) == [n.capitalize() for n in names]
    assert apply(tx.snippet_key, ["/__a/b.c"]) == ["a_b_c"]
    assert apply(lambda c: tx.snippet_key(c, False), ["/__a/b.c"]) == ["__a_b_c"]
    assert apply(tx.module_path, ["a/b/c.py", "a.b/c.d.py"]) == ["a.b.c", "a.b.c.d"]
    assert apply(lambda c: tx.module_of_concept(c, "/fw/"), ["/fw/a.b.C", "/fw/x", "nodot"]) == ["a.b", "", ""]
    assert apply(tx.repo_folder, ["tensorflow/quantum", "org/name"]) == ["tensorflow-quantum", "name"]
    assert apply(tx.preview, [None, "x" * 101]) == ["N/A", "x" * 100 + "..."]
    assert apply(tx.score_text, [0.03125, 0.09375, 0.9], "double") == ["0.0312", "0.0938", "0.9000"]
    rnd = random.Random(1)
    near = [0.41205, 0.68225, -0.00005, -0.41205, 0.0, 1.0, 12345.00005, 99999.99995, None] + [n / 20000 for n in range(1, 4001, 2)] + [
        rnd.uniform(-1, 1) for _ in range(1000)]
    assert apply(tx.score_text, near, "double") == [None if x is None else "%.4f" % x for x in near]
    assert apply(tx.kappa_label, [-0.1, 0.2, 0.21, 0.6, 0.8, 0.81], "double") == [
        "Poor agreement", "Slight agreement", "Fair agreement", "Moderate agreement", "Substantial agreement",
        "Almost perfect agreement"]


def test_doc_blocks_go_with_their_body():
    assert drop_doc_blocks("Text.\n\n.. code-block:: text\n\n    some code\n    more\n") == "Text."
    # the block pattern also takes the first line after the blank one that ends it
    assert drop_doc_blocks("T.\n\n.. math::\n\n    a + b\n\nLost.\nEnd.") == "T.\n\nEnd."
    assert drop_doc_blocks("A simple one.") == "A simple one."


def test_html_to_text():
    html = ("<!DOCTYPE html><title> T &amp; x</title><style>p{}</style><script>var t='</p>';</script>"
            "<p>one<b> two </b>&eacute;<!-- no -->three<br/>four</p><template><i>no</i></template>end")
    assert plain_text(html) == "T & x one two é three four end"
    assert plain_text("") == "" and plain_text(None) is None and plain_text(" plain ") == "plain"


def test_score_text_is_compiled_and_exact_next_to_ties(spark, apply):
    import math
    rnd = random.Random(7)
    ties = [(rnd.randrange(10 ** rnd.randrange(1, 15)) + 0.5) / 10000 for _ in range(500)]
    values = [f(v) for v in ties for f in (float, lambda v: math.nextafter(v, 0), lambda v: math.nextafter(v, math.inf), lambda v: -v)]
    assert apply(tx.score_text, values, "double") == ["%.4f" % v for v in values]
    plan = spark.range(3).select(tx.score_text(F.col("id") / 7).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
