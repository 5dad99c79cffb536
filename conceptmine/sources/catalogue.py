"""Pattern catalogue from harvested JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptmine.operators.html import html_text

# Section names of a catalogue entry and the text of an absent one (fixed values).
SECTIONS = ["Intent", "Alias", "Context", "Forces", "Solution", "Result"]
ABSENT = "Not available"
ENTRY = "array<struct<id string, name string, patternLanguageId string>>"


def entries(listing: DataFrame, json: str = "json") -> DataFrame:
    """Listing answers to valid ``(id, name, language_id)`` rows."""
    models = F.from_json(json, f"struct<_embedded: struct<patternModels: {ENTRY}>>")["_embedded"]["patternModels"]
    rows = listing.select(F.inline(models)).withColumnRenamed("patternLanguageId", "language_id")
    return rows.where((F.col("id") != "") & (F.col("name") != "") & (F.col("language_id") != ""))


def details(answers: DataFrame, json: str = "json") -> DataFrame:
    """``(name, json)`` answers to catalogue rows in plain text; answers without content drop out."""
    content = F.from_json(json, "struct<renderedContent: map<string, string>>")["renderedContent"]
    filled = answers.select("name", content.alias("content")).where(F.size("content") > 0)
    return filled.select("name", *[
        html_text(F.coalesce(F.col("content")[s], F.lit(ABSENT))).alias(s.lower()) for s in SECTIONS])
