"""Filters, ranking and language statistics over harvested repository metadata."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptmine.functions import text as tx
from conceptmine.operators.ranking import first_wins, last_wins, numbered

# Search limits and thresholds (fixed values).
MIN_STARS = 30
MIN_CONTRIBUTORS = 10
MAX_INACTIVE_MONTHS = 12
TOP_REPOSITORIES = 200
SURVEY_CAP = 500
# Hits taken of each search query (fixed value).
SEARCH_CAP = 200
SURVEY_MIN_STARS = 10
EXCLUSION_KEYWORDS = ["awesome-list", "books"]
UNKNOWN_LANGUAGE = "Unknown/Docs"
ECOSYSTEM = ["Python", "Jupyter Notebook"]
RATE_LIMITED = 403


def exclusion_reason(keywords: list[str] = EXCLUSION_KEYWORDS) -> Column:
    """First keyword found, text before topic; null when none is."""
    text = F.concat_ws(" ", F.lower("full_name"), F.coalesce(F.lower("description"), F.lit("")))
    topics = F.transform("topics", lambda t: F.lower(t))
    reasons = []
    for word in keywords:
        reasons.append(F.when(F.contains(text, F.lit(word)), f"Keyword '{word}' in name/description"))
        reasons.append(F.when(F.array_contains(topics, word), f"Topic '{word}'"))
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def rejection_reason(as_of: dt.datetime) -> Column:
    """First failing check of a repository, null when it passes.

    An unknown contributor count passes, unless ``contributors_status`` says
    the count was refused by the rate limit.
    """
    oldest = F.lit(as_of).cast("timestamp") - F.make_ym_interval(F.lit(0), F.lit(MAX_INACTIVE_MONTHS))
    stars, people = F.col("stargazers_count"), F.col("contributors_count")
    return (
        F.when(F.col("archived"), "Archived repository")
        .when(F.col("fork"), "Is a fork")
        .when(stars < MIN_STARS, F.format_string(f"Not enough stars (%d < {MIN_STARS})", stars))
        .when(F.col("pushed_at") < oldest,
              F.concat(F.lit("Inactive since "), F.date_format("pushed_at", "yyyy-MM-dd")))
        .when(exclusion_reason().isNotNull(), F.concat(F.lit("Excluded by "), exclusion_reason()))
        .when(F.col("contributors_status") == RATE_LIMITED,
              f"Could not fetch contributors due to API limits ({RATE_LIMITED})")
        .when(people < MIN_CONTRIBUTORS,
              F.format_string(f"Not enough contributors (%d < {MIN_CONTRIBUTORS})", people))
    )


def with_reason(repos: DataFrame, as_of: dt.datetime) -> DataFrame:
    return repos.withColumn("reason", rejection_reason(as_of))


def candidates(harvest: DataFrame, cap: int | None = None, known: int = 0) -> DataFrame:
    """``harvest(source_ord, pos, ...)``: known list first, then queries; first row of a name wins.

    ``cap`` limits the hits taken of each query, as a search does (``SEARCH_CAP``); the known list,
    ``source_ord`` up to ``known``, has no limit.
    """
    if cap is not None:
        listed = F.col("source_ord") <= known
        harvest = harvest.where(listed).unionByName(capped(harvest.where(~listed), "source_ord", cap, [F.col("pos")]))
    return first_wins(harvest, ["full_name"], [F.col("source_ord"), F.col("pos")])


def latest_by_id(harvest: DataFrame) -> DataFrame:
    """Last row of an id wins; ``first_seen`` is where the id came up first."""
    order = ["source_ord", "pos"]
    seen = harvest.groupBy("id").agg(F.min(F.struct(*order)).alias("first_seen"))
    return last_wins(harvest, ["id"], [F.col(c) for c in order]).join(seen, "id")


def capped(harvest: DataFrame, group: str, cap: int, order: list[Column], slices: int = 64) -> DataFrame:
    """First ``cap`` rows of each group.

    Ranks are cut inside hash slices of a group first (Spark limits them again
    before the shuffle), so the last task of a group sees ``cap * slices`` rows
    at most, however large the group is.
    """
    part = F.pmod(F.xxhash64(*harvest.columns), F.lit(slices))
    in_slice = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(*order))
    overall = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    few = harvest.withColumn("_slice", part).withColumn("_place", in_slice).where(F.col("_place") <= cap)
    return few.withColumn("_place", overall).where(F.col("_place") <= cap).drop("_place", "_slice")


def survey(harvest: DataFrame, cap: int = SURVEY_CAP) -> DataFrame:
    """No forks, enough stars, then the cap (it counts accepted rows), then one row per id."""
    accepted = harvest.where(~F.col("fork") & (F.col("stargazers_count") >= SURVEY_MIN_STARS))
    order = [F.desc("stargazers_count"), F.col("pos")]
    return latest_by_id(capped(accepted, "source_ord", cap, order))


def ranked(repos: DataFrame, as_of: dt.datetime, top: int = TOP_REPOSITORIES) -> DataFrame:
    """The ``top`` passing repositories by stars (stable in ``source_ord, pos``) with their rank."""
    passing = with_reason(repos, as_of).where(F.col("reason").isNull())
    best = passing.orderBy(F.desc("stargazers_count"), "source_ord", "pos").limit(top)
    # the window sees at most `top` rows
    rank = F.row_number().over(Window.orderBy(F.desc("stargazers_count"), "source_ord", "pos"))
    return best.withColumn("rank", rank).drop("reason")


def verdicts(repos: DataFrame, as_of: dt.datetime, top: int = TOP_REPOSITORIES) -> DataFrame:
    """Every candidate with its final reason; passing rows beyond the top get one too."""
    chosen = ranked(repos, as_of, top).select("full_name", "rank")
    # at most `top` rows
    judged = with_reason(repos, as_of).join(F.broadcast(chosen), "full_name", "left")
    beyond = F.format_string(
        f"Passed filters but not in top {top} by stars (%d stars)", F.col("stargazers_count"))
    reason = F.when(F.col("reason").isNull() & F.col("rank").isNull(), beyond).otherwise(F.col("reason"))
    return judged.withColumn("reason", reason)


def rejected(judged: DataFrame) -> DataFrame:
    """Filtered-out repositories, sorted by name without regard to case."""
    return judged.where(F.col("reason").isNotNull()).select("full_name", "reason").orderBy(
        F.lower("full_name"), "full_name")


def funnel(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count("*").alias("candidates"), F.count("reason").alias("filtered"),
        F.count_if(F.col("reason").isNull()).alias("final"))


def ranked_output(top: DataFrame) -> DataFrame:
    """Columns of the published repository list."""
    people = F.coalesce(F.col("contributors_count").cast("string"), F.lit(tx.MISSING))
    pushed = F.date_format("pushed_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return top.select(
        "rank", "full_name", "stargazers_count", people.alias("contributors_count"), "forks_count",
        pushed.alias("pushed_at"), "description", "html_url")


def language_distribution(repos: DataFrame) -> DataFrame:
    """``(language, repos, percentage)``; the total comes from the counted groups."""
    language = F.coalesce(F.when(F.col("language") != "", F.col("language")), F.lit(UNKNOWN_LANGUAGE))
    counted = repos.groupBy(language.alias("language")).agg(F.count("*").alias("repos"))
    total = counted.agg(F.sum("repos").alias("n")).scalar()
    return counted.withColumn("percentage", F.col("repos") / total * 100)


def ranked_languages(distribution: DataFrame) -> DataFrame:
    table = numbered(distribution, [F.desc("repos"), F.col("language")], "Rank")
    return table.select(
        "Rank", F.col("language").alias("Language"), F.col("repos").alias("Count"),
        F.format_string("%.2f%%", "percentage").alias("Percentage"))


def ecosystem_share(distribution: DataFrame, members: list[str] = ECOSYSTEM) -> DataFrame:
    """Share of the languages that form one ecosystem, and of all others."""
    inside = F.sum(F.when(F.col("language").isin(members), F.col("repos")).otherwise(0))
    share = F.when(F.sum("repos") > 0, inside / F.sum("repos") * 100).otherwise(F.lit(0.0))
    return distribution.agg(share.alias("ecosystem")).select("ecosystem", (100 - F.col("ecosystem")).alias("other"))
