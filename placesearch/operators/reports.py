"""Stored answers and hits -> texts, one row per search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placesearch.functions import answers as text


def _contents():
    return F.transform("results", lambda r: r["content"])


def contents(searches: DataFrame) -> DataFrame:
    """All hit texts of a search in rank order, as input for a summary."""
    return searches.select("search_id", text.join_contents(_contents()).alias("contents"))


def results_reports(searches: DataFrame) -> DataFrame:
    return searches.select("search_id", text.results_report(F.col("query"), _contents())
                           .alias("report"),
                           text.results_markdown(_contents()).alias("page"))


def summaries(searches: DataFrame) -> DataFrame:
    """Answers with their hits' names linked and the headline set: ``search_id, summary``."""
    hits = F.transform("results", lambda r: F.struct(r["Restaurant"].alias("name"),
                                                     r["URL"].alias("url")))
    linked = searches.select("search_id", "query",
                             text.link_entities(F.col("answer"), hits).alias("linked"))
    return linked.select("search_id", "query", "linked",
                         text.standardize_headline(F.col("linked")).alias("summary"))


def summary_reports(summarised: DataFrame) -> DataFrame:
    return summarised.select(
        "search_id", text.summary_report(F.col("query"), F.col("summary")).alias("report"),
        text.summary_report(F.col("query"), F.col("summary"), label=False).alias("plain_report"))
