"""Registered queries: the search log as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from placesearch.plans.files import new_folder
from placesearch.plans.inputs import SQL_LOG, table
from placesearch.streaming import log


def searches(spark, d):
    """The events file as a stream of searches, every one of them sent twice."""
    key = F.col("event_id")
    events = (spark.readStream.schema(table(spark, d, "events").schema)
              .option("pathGlobFilter", "events.parquet").parquet(d))
    return events.select(
        F.md5(key.cast("string")).alias("search_id"), F.col("props").alias("query"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.get_json_object("props", "$.k").cast("int") % 10 + 1).alias("num_results"),
        F.when(key % 2 == 0, "summary").otherwise("detailed").alias("search_type"),
        F.when(F.col("event_type") == "purchase", "y").when(F.col("event_type") == "error", "n")
        .alias("feedback_success"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")


def _daily(spark, d):
    return log.keep_daily(searches(spark, d), new_folder(spark)).withColumns({
        "search_date": F.date_format("search_date", "yyyy-MM-dd"),
        "avg_results_requested": F.round("avg_results_requested", 6)})


def _deduped(spark, d):
    return log.run_available(log.dedupe_searches(searches(spark, d)), new_folder(spark)).select(
        "search_id", "query", "num_results", "search_type")


QUERIES = {"stream_daily_analytics": _daily, "stream_search_log": _deduped}

SQL = {
    "stream_daily_analytics": f"""WITH {SQL_LOG}, r AS (
      SELECT date_trunc('day', "timestamp") AS day, count(*) AS total_searches,
        count(DISTINCT query) AS unique_queries, round(avg(num_results), 6) AS avg_results_requested,
        count(*) FILTER (WHERE search_type = 'summary') AS summary_searches,
        count(*) FILTER (WHERE search_type = 'detailed') AS detailed_searches,
        count(*) FILTER (WHERE feedback_success = 'y') AS successful_feedback,
        count(*) FILTER (WHERE feedback_success = 'n') AS unsuccessful_feedback
      FROM search_log GROUP BY 1)
      SELECT strftime(day, '%Y-%m-%d') AS search_date, * EXCLUDE day FROM r""",
    "stream_search_log": f"""WITH {SQL_LOG} SELECT search_id, query, num_results, search_type
      FROM search_log""",
}
