"""The search log: one row per search, one row per hit, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placesearch.operators.rows import explode_once

SEARCH_COLUMNS = ("id", "search_id", "query", "timestamp", "user_id", "langsmith_run_id",
                  "filter_applied", "num_results", "search_type", "feedback_success",
                  "feedback_reason", "created_at")
SCORE_COLUMNS = ("id", "search_id", "restaurant_id", "restaurant_name", "city", "state",
                 "region", "honor_roll", "recommend", "relevant", "adjusted_score", "longitude",
                 "latitude", "sig_item", "url", "similarity_score", "rank", "metadata",
                 "created_at")
VIEW_SCORE_COLUMNS = ("restaurant_id", "restaurant_name", "city", "state", "region",
                      "honor_roll", "recommend", "relevant", "adjusted_score", "longitude",
                      "latitude", "sig_item", "similarity_score", "rank")


def derived_id(*parts: str | Column) -> Column:
    """An id made from the row itself: a task that runs again writes the same id."""
    return F.md5(F.to_json(F.struct(*[
        (F.col(p) if isinstance(p, str) else p).cast("string").alias(f"c{i}")
        for i, p in enumerate(parts)])))


def search_rows(requests: DataFrame) -> DataFrame:
    """Finished requests -> log rows.

    ``requests``: ``request_id, query, timestamp, user_id, langsmith_run_id, filter_applied,
    article BOOLEAN, results ARRAY<STRUCT>``.  ``request_id`` is what the writer numbers its
    requests by: two searches that agree in everything else are still two.
    """
    search_id = derived_id("request_id", "langsmith_run_id", "query", "timestamp", "user_id")
    return requests.select(
        derived_id(F.lit("search"), search_id).alias("id"), search_id.alias("search_id"),
        "query", "timestamp", "user_id", "langsmith_run_id", "filter_applied",
        F.coalesce(F.size("results"), F.lit(0)).alias("num_results"),
        F.when(F.col("article"), "summary").otherwise("detailed").alias("search_type"),
        F.lit(None).cast("string").alias("feedback_success"),
        F.lit(None).cast("string").alias("feedback_reason"),
        F.col("timestamp").alias("created_at"))


def score_rows(searches: DataFrame) -> DataFrame:
    """One row per hit of ``search_id, timestamp, results``; the rank is the result order.

    A result carries the document's metadata under the directory's own column names.
    """
    hits = explode_once(searches, ["search_id", "timestamp"], F.col("results"), "r")
    r = F.col("r")
    return hits.select(
        derived_id("search_id", "pos").alias("id"), "search_id",
        r["ID"].cast("string").alias("restaurant_id"),
        r["Restaurant"].alias("restaurant_name"),
        r["City"].alias("city"), r["State"].alias("state"), r["Region"].alias("region"),
        F.coalesce(r["Honor Roll"], F.lit("n")).alias("honor_roll"),
        F.coalesce(r["Recommend"], F.lit("n")).alias("recommend"),
        F.lit(None).cast("string").alias("relevant"),
        F.lit(None).cast("double").alias("adjusted_score"),
        r["long"].alias("longitude"), r["lat"].alias("latitude"),
        F.coalesce(r["sig_item"], F.lit("")).alias("sig_item"),
        F.coalesce(r["URL"], F.lit("")).alias("url"),
        r["similarity_score"].alias("similarity_score"),
        (F.col("pos") + 1).alias("rank"),
        F.to_json(r).alias("metadata"),
        F.col("timestamp").alias("created_at"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Fill the declared defaults of whichever log table ``rows`` belongs to.

    A missing id is drawn at random, so rows that agree in everything still differ; write the
    result before it is used twice.
    """
    defaults = {"id": F.uuid(), "timestamp": F.current_timestamp(),
                "created_at": F.current_timestamp(), "honor_roll": F.lit("n"),
                "recommend": F.lit("n")}
    return rows.withColumns({c: F.coalesce(F.col(c), value) for c, value in defaults.items()
                             if c in rows.columns})


def searches_with_scores(searches: DataFrame, scores: DataFrame) -> DataFrame:
    """Every search with its hits, newest first."""
    left = searches.select(*[c for c in SEARCH_COLUMNS if c != "created_at"])
    right = scores.select("search_id", *VIEW_SCORE_COLUMNS)
    return (left.join(right, "search_id", "left")
            .select(*left.columns, *VIEW_SCORE_COLUMNS)
            .orderBy(F.col("timestamp").desc_nulls_first(), F.col("rank").asc_nulls_last()))


def get_search(searches: DataFrame, scores: DataFrame, search_id: str) -> DataFrame:
    """One search with all its columns and its hits by rank; an unknown id gives no rows.

    Columns that both tables have carry ``hit_`` on the side of the hits.
    """
    wanted = F.col("search_id") == search_id
    hits = scores.filter(wanted).select("search_id", *[
        F.col(c).alias(f"hit_{c}" if c in SEARCH_COLUMNS else c)
        for c in SCORE_COLUMNS if c != "search_id"])
    return (searches.filter(wanted).select(*SEARCH_COLUMNS).join(hits, "search_id", "left")
            .orderBy("rank"))


def daily_analytics(searches: DataFrame) -> DataFrame:
    """The rollup per day."""
    return searches.groupBy(F.date_trunc("day", "timestamp").alias("search_date")).agg(
        F.count_distinct("search_id").alias("total_searches"),
        F.count_distinct("query").alias("unique_queries"),
        F.avg("num_results").alias("avg_results_requested"),
        F.count_if(F.col("search_type") == "summary").alias("summary_searches"),
        F.count_if(F.col("search_type") == "detailed").alias("detailed_searches"),
        F.count_if(F.col("feedback_success") == "y").alias("successful_feedback"),
        F.count_if(F.col("feedback_success") == "n").alias("unsuccessful_feedback"))


def top_entities(scores: DataFrame, searches: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` places found by most searches; ties go to the lower id."""
    place = ["restaurant_id", "restaurant_name", "city", "state"]
    hits = scores.select("search_id", *place, "similarity_score", "rank")
    return (hits.join(searches.select("search_id"), "search_id").groupBy(*place)
            .agg(F.count_distinct("search_id").alias("search_count"),
                 F.avg("similarity_score").alias("avg_similarity_score"),
                 F.avg("rank").alias("avg_rank"))
            .orderBy(F.col("search_count").desc(), *[F.col(c).asc_nulls_last() for c in place])
            .limit(n))


def cascade_delete(searches: DataFrame, scores: DataFrame,
                   doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the searches of ``doomed(search_id)`` and their hits."""
    gone = doomed.select("search_id")
    return (searches.join(gone, "search_id", "left_anti"),
            scores.join(gone, "search_id", "left_anti"))


def feedback_merge(searches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Put the latest ``(run_id, score, comment, at)`` of each run into the log."""
    latest = (feedback.groupBy("run_id")
              .agg(F.max(F.struct("at", "score", "comment")).alias("f"))
              .select(F.col("run_id").alias("langsmith_run_id"), "f.score", "f.comment"))
    given = F.col("score").isNotNull()
    return searches.join(latest, "langsmith_run_id", "left").withColumns({
        "feedback_success": F.when(F.col("score") == 1, "y").when(F.col("score") == 0, "n")
        .otherwise(F.col("feedback_success")),
        "feedback_reason": F.when(given, F.col("comment"))
        .otherwise(F.col("feedback_reason")),
    }).select(*searches.columns)
