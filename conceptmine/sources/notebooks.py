"""Notebook JSON to script text, and which notebooks need converting.

A notebook is converted inside its own row with array functions: no explode,
no regrouping, so notebooks of any number spread over tasks as they were read.
Python sees only the code cells that may hold shell syntax.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from conceptmine.sources.shell import MARKS, plain_code

# Head of every converted script (fixed value).
SCRIPT_HEAD = "#!/usr/bin/env python\n# coding: utf-8\n"
CELL = "struct<cell_type string, source variant, input variant, execution_count int, prompt_number int>"


SHEET = f"struct<cells array<{CELL}>>"


@F.pandas_udf(ArrayType(StringType()))
def _plain_cells(cells: pd.Series) -> pd.Series:
    """Code cells as plain Python; null entries are left alone."""
    return cells.map(lambda own: own if own is None else [c if c is None else plain_code(c) for c in own])


def _source(cell: Column) -> Column:
    raw = F.coalesce(cell["source"], cell["input"])
    return F.coalesce(
        F.array_join(F.try_variant_get(raw, "$", "array<string>"), ""),
        F.try_variant_get(raw, "$", "string"), F.lit(""))


def _cells(tree: Column) -> Column:
    """All cells; an older format has them in worksheets."""
    sheets = F.try_variant_get(tree, "$.worksheets", f"array<{SHEET}>")
    old = F.flatten(F.transform(sheets, lambda s: F.coalesce(s["cells"], F.array().cast(f"array<{CELL}>"))))
    return F.coalesce(F.try_variant_get(tree, "$.cells", f"array<{CELL}>"), old)


def _cell_text(cell: Column, source: Column, plain: Column) -> Column:
    count = F.coalesce(cell["execution_count"], cell["prompt_number"])
    label = F.when(count != 0, count.cast("string")).otherwise(" ")
    code = F.concat(F.lit("\n# In["), label, F.lit("]:\n\n\n"), F.coalesce(plain, source), F.lit("\n\n"))
    prose = F.concat(F.lit("\n# "), F.replace(source, F.lit("\n"), F.lit("\n# ")), F.lit("\n"))
    return F.when(cell["cell_type"] == "code", code).when(
        cell["cell_type"].isin("markdown", "heading"), prose).otherwise("")


def script_path(c: Column) -> Column:
    return F.regexp_replace(c, r"\.ipynb$", ".py")


def convert(notebooks: DataFrame) -> DataFrame:
    """``(path, text, ...)`` of notebooks to the same rows with ``.py`` path and script text.

    ``text`` is null where the JSON holds no cells.
    """
    parsed = notebooks.withColumn("_cells", _cells(F.try_parse_json("text")))
    parsed = parsed.withColumn("_sources", F.transform("_cells", _source))
    # only cells that may hold shell syntax go to Python, and no notebook without one
    odd = F.zip_with("_cells", "_sources", lambda c, s: F.when((c["cell_type"] == "code") & s.rlike(MARKS), s))
    parsed = parsed.withColumn("_plain", _plain_cells(F.when(F.exists(odd, lambda s: s.isNotNull()), odd)))
    place = F.sequence(F.lit(1), F.size("_cells"))
    body = F.array_join(F.when(F.size("_cells") > 0, F.transform(place, lambda i: _cell_text(
        F.element_at("_cells", i), F.element_at("_sources", i), F.element_at("_plain", i)))).otherwise(F.array()), "")
    return parsed.withColumns({
        "text": F.when(F.col("_cells").isNotNull(), F.concat(F.lit(SCRIPT_HEAD), body)),
        "path": script_path(F.col("path")),
    }).drop("_cells", "_sources", "_plain")


def conversion_status(notebooks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``status``: SKIPPED when the target is not older, else SUCCESS or ERROR.

    ``manifest(path, converted)`` lists the scripts already written and when.
    """
    target = manifest.select(F.col("path").alias("script_path"), F.col("converted"))
    joined = notebooks.withColumn("script_path", script_path(F.col("path"))).join(target, "script_path", "left")
    readable = F.try_variant_get(F.try_parse_json("text"), "$.cells", "array<variant>").isNotNull() | (
        F.try_variant_get(F.try_parse_json("text"), "$.worksheets", "array<struct<cells array<variant>>>").isNotNull())
    status = (
        F.when(F.col("converted") >= F.col("modified"), "SKIPPED")
        .when(readable, "SUCCESS").otherwise("ERROR"))
    return joined.withColumn("status", status)


def pending(notebooks: DataFrame, manifest: DataFrame) -> DataFrame:
    """New or changed notebooks only; up-to-date ones drop out before any JSON is read."""
    target = manifest.select(F.col("path").alias("script_path"), F.col("converted"))
    joined = notebooks.withColumn("script_path", script_path(F.col("path"))).join(target, "script_path", "left")
    fresh = F.col("converted").isNull() | (F.col("converted") < F.col("modified"))
    return joined.where(fresh).drop("script_path", "converted")


def status_counts(statuses: DataFrame) -> DataFrame:
    """Counts of all three statuses in one row, zeros included."""
    return statuses.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("SUCCESS", "SKIPPED", "ERROR")])
