"""Registered queries: search log and analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placesearch.operators import contracts, searchlog as log
from placesearch.plans.inputs import (
    SQL_LOG, SQL_REQUESTS, directory, requests, score_log, search_log, table,
)


def _as_text(df: DataFrame, column: str) -> DataFrame:
    """Times as text, so that both engines write them alike."""
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _logged(spark, d):
    return search_log(spark, d), score_log(spark, d)


def _search_rows(spark, d):
    # every tenth search comes a second time, alike in all but its request
    asked = requests(spark, d)
    again = asked.filter(F.col("request_id") % 10 == 0).withColumn("request_id", -F.col("request_id") - 1)
    rows = log.search_rows(asked.unionByName(again))
    same = rows.groupBy("search_id").agg(F.count("*").alias("rows_with_id"))
    return _as_text(rows, "timestamp").join(same, "search_id").select(
        "query", "timestamp", "user_id", "langsmith_run_id", "filter_applied", "num_results",
        "search_type", "feedback_success", F.length("search_id").alias("id_length"), "rows_with_id")


def _score_rows(spark, d):
    asked = requests(spark, d).withColumn("search_id", F.col("langsmith_run_id"))
    return _as_text(log.score_rows(asked).drop("id", "metadata"), "created_at")


def _get_search(spark, d):
    searches, scores = _logged(spark, d)
    latest = searches.agg(F.max_by("search_id", F.struct("timestamp", "search_id")).alias("s"))
    found = log.get_search(searches, scores, latest.first().s)
    for column in ("timestamp", "created_at", "hit_created_at"):
        found = _as_text(found, column)
    return found


def _daily(spark, d):
    return log.daily_analytics(search_log(spark, d)).withColumns({
        "search_date": F.date_format("search_date", "yyyy-MM-dd"),
        "avg_results_requested": F.round("avg_results_requested", 6)})


def _top(spark, d):
    searches, scores = _logged(spark, d)
    return log.top_entities(scores, searches).withColumns({
        "avg_similarity_score": F.round("avg_similarity_score", 6),
        "avg_rank": F.round("avg_rank", 6)})


def flawed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Both log tables with bad rows."""
    searches, scores = _logged(spark, d)
    n = F.substring("langsmith_run_id", 5, 20).cast("long")
    return (searches.withColumns({
        "search_type": F.when(n % 50 == 0, "other").otherwise(F.col("search_type")),
        "query": F.when(n % 70 != 0, F.col("query")),
        "search_id": F.when(n % 90 == 0, F.lit("twice")).otherwise(F.col("search_id"))}),
        scores.withColumns({
            "honor_roll": F.when(F.col("restaurant_id") == "3", "x").otherwise(F.col("honor_roll")),
            "rank": F.when(F.col("rank") == 7, 0).otherwise(F.col("rank")),
            "similarity_score": F.col("similarity_score") - 0.03}))


def _cascade(spark, d):
    searches, scores = _logged(spark, d)
    left, kept = log.cascade_delete(searches, scores, searches.filter("feedback_success = 'n'"))
    return kept.groupBy(F.col("restaurant_id").alias("key")).agg(F.count("*").alias("n")).unionByName(
        left.groupBy(F.col("search_type").alias("key")).agg(F.count("*").alias("n")))


def _defaults(spark, d):
    rows = score_log(spark, d)
    holed = rows.withColumns({"id": F.when(F.col("rank") > 2, F.col("id")),
                              "created_at": F.when(F.col("rank") > 3, F.col("created_at"))})
    return log.with_defaults(holed).select(
        "search_id", "restaurant_id", "rank", "honor_roll", "recommend",
        F.col("id").isNotNull().alias("has_id"), F.col("created_at").isNotNull().alias("has_time"))


def _feedback(spark, d):
    given = table(spark, d, "events").select(
        F.concat(F.lit("run-"), F.floor(F.col("event_id") / 2) * 3).alias("run_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("score"),
        F.concat(F.lit("note "), "event_id").alias("comment"), F.col("ts").alias("at"))
    return log.feedback_merge(search_log(spark, d), given).select(
        "search_id", "langsmith_run_id", "feedback_success", "feedback_reason")


def _contract(spark, d):
    searches, scores = _logged(spark, d)
    return contracts.contract_report(searches, scores,
                                     log.searches_with_scores(searches, scores),
                                     log.daily_analytics(searches))


def _required(spark, d):
    return contracts.required_columns({
        "guide": (directory(spark, d).select(F.col("Restaurant").alias("title"), "phone"),
                  ("title", "State")),
        "directory": (directory(spark, d), ("Restaurant", "State", "sig_item"))})


QUERIES = {
    "search_rows": _search_rows,
    "score_rows": _score_rows,
    "get_search": _get_search,
    "searches_with_scores": lambda spark, d: _as_text(
        log.searches_with_scores(*_logged(spark, d)), "timestamp"),
    "daily_analytics": _daily,
    "top_entities": _top,
    "check_constraints": lambda spark, d: contracts.check_constraints(*flawed(spark, d)),
    "column_defaults": _defaults,
    "cascade_delete": _cascade,
    "contract_report": _contract,
    "feedback_merge": _feedback,
    "required_columns": _required,
}

_TIME = """strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f')"""
_VIEW = """s.id, s.search_id, s.query, s."timestamp", s.user_id, s.langsmith_run_id,
  s.filter_applied, s.num_results, s.search_type, s.feedback_success, s.feedback_reason,
  r.restaurant_id, r.restaurant_name, r.city, r.state, r.region, r.honor_roll, r.recommend,
  r.relevant, r.adjusted_score, r.longitude, r.latitude, r.sig_item, r.similarity_score, r.rank"""

_FLAWED = f"""WITH {SQL_LOG},
s AS (SELECT * REPLACE (
    CASE WHEN n % 50 = 0 THEN 'other' ELSE search_type END AS search_type,
    CASE WHEN n % 70 <> 0 THEN query END AS query,
    CASE WHEN n % 90 = 0 THEN 'twice' ELSE search_id END AS search_id)
  FROM (SELECT *, substr(langsmith_run_id, 5)::BIGINT AS n FROM search_log)),
r AS (SELECT * REPLACE (
    CASE WHEN restaurant_id = '3' THEN 'x' ELSE honor_roll END AS honor_roll,
    CASE WHEN rank = 7 THEN 0 ELSE rank END AS rank, similarity_score - 0.03 AS similarity_score)
  FROM score_log),
"""


def _rules(s: str, r: str) -> str:
    rules = [
        (s, "search_results", "NOT NULL", "id", "id IS NULL"),
        (s, "search_results", "NOT NULL", "search_id", "search_id IS NULL"),
        (s, "search_results", "NOT NULL", "query", "query IS NULL"),
        (s, "search_results", "NOT NULL", "timestamp", '"timestamp" IS NULL'),
        (s, "search_results", "NOT NULL", "created_at", '"timestamp" IS NULL'),
        (s, "search_results", "CHECK", "search_type in (detailed, summary)",
         "search_type NOT IN ('detailed', 'summary')"),
        (s, "search_results", "CHECK", "feedback_success in (y, n)",
         "feedback_success NOT IN ('y', 'n')"),
        (r, "result_scores", "NOT NULL", "id", "false"),
        (r, "result_scores", "NOT NULL", "search_id", "search_id IS NULL"),
        (r, "result_scores", "NOT NULL", "restaurant_id", "restaurant_id IS NULL"),
        (r, "result_scores", "NOT NULL", "restaurant_name", "restaurant_name IS NULL"),
        (r, "result_scores", "NOT NULL", "similarity_score", "similarity_score IS NULL"),
        (r, "result_scores", "NOT NULL", "rank", "rank IS NULL"),
        (r, "result_scores", "NOT NULL", "created_at", "false"),
        (r, "result_scores", "CHECK", "honor_roll in (y, n)", "honor_roll NOT IN ('y', 'n')"),
        (r, "result_scores", "CHECK", "recommend in (y, n)", "recommend NOT IN ('y', 'n')"),
        (r, "result_scores", "CHECK", "relevant in (y, n)", "relevant NOT IN ('y', 'n')"),
        (r, "result_scores", "CHECK", "similarity_score >= 0", "similarity_score < 0"),
        (r, "result_scores", "CHECK", "rank > 0", "rank <= 0"),
    ]
    parts = [f"SELECT '{t}' AS \"table\", '{k}' AS type, '{n}' AS rule, "
             f"count(*) FILTER (WHERE {c}) AS violations FROM {src}"
             for src, t, k, n, c in rules]
    parts += [f"SELECT 'search_results', 'UNIQUE', '{c}', count(*) FROM (SELECT {c} FROM {s} "
              f"WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1)"
              for c in ("id", "search_id")]
    parts += ["SELECT 'result_scores', 'UNIQUE', 'id', count(*) FROM (SELECT 1 FROM lineitem "
              "GROUP BY l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_shipdate "
              "HAVING count(*) > 1)"]
    parts += [f"SELECT 'result_scores', 'FOREIGN KEY', 'search_id', count(*) FROM {r} WHERE "
              f"search_id NOT IN (SELECT search_id FROM {s})"]
    return " UNION ALL ".join(parts)


_COLUMNS = {
    "search_results": {
        "id": "string NOT NULL DEFAULT generated", "search_id": "string NOT NULL",
        "query": "string NOT NULL", "timestamp": "timestamp NOT NULL DEFAULT now",
        "user_id": "string", "langsmith_run_id": "string", "filter_applied": "string",
        "num_results": "int", "search_type": "string", "feedback_success": "string",
        "feedback_reason": "string", "created_at": "timestamp NOT NULL DEFAULT now"},
    "result_scores": {
        "id": "string NOT NULL DEFAULT generated", "search_id": "string NOT NULL",
        "restaurant_id": "string NOT NULL", "restaurant_name": "string NOT NULL",
        "city": "string", "state": "string", "region": "string",
        "honor_roll": "string DEFAULT n", "recommend": "string DEFAULT n",
        "relevant": "string", "adjusted_score": "double", "longitude": "double",
        "latitude": "double", "sig_item": "string", "url": "string",
        "similarity_score": "double NOT NULL", "rank": "int NOT NULL", "metadata": "string",
        "created_at": "timestamp NOT NULL DEFAULT now"},
}
_COLUMN_ROWS = ", ".join(f"('{t}', 'column', '{c}', '{k}')"
                         for t, columns in _COLUMNS.items() for c, k in columns.items())

SQL = {
    "search_rows": f"""WITH {SQL_REQUESTS} SELECT query, {_TIME} AS "timestamp", user_id, langsmith_run_id,
      filter_applied, found AS num_results, CASE WHEN article THEN 'summary' ELSE 'detailed' END
      AS search_type, NULL::VARCHAR AS feedback_success, 32 AS id_length, 1::BIGINT AS rows_with_id
      FROM (FROM requests UNION ALL FROM requests WHERE event_id % 10 = 0)""",
    "score_rows": f"""WITH {SQL_REQUESTS} SELECT 'run-' || event_id AS search_id,
      "ID"::VARCHAR AS restaurant_id, "Restaurant" AS restaurant_name, "City" AS city,
      "State" AS state, "Region" AS region, coalesce("Honor Roll", 'n') AS honor_roll,
      coalesce("Recommend", 'n') AS recommend, NULL::VARCHAR AS relevant,
      NULL::DOUBLE AS adjusted_score, long AS longitude, lat AS latitude,
      coalesce(sig_item, '') AS sig_item, "URL" AS url, similarity_score, rank,
      {_TIME} AS created_at FROM results""",
    "get_search": f"""WITH {SQL_LOG}, latest AS (
        SELECT * FROM search_log ORDER BY "timestamp" DESC, search_id DESC LIMIT 1)
      SELECT {_VIEW.replace('s."timestamp"', _TIME.replace('"timestamp"', 's."timestamp"') + ' AS "timestamp"')},
        {_TIME.replace('"timestamp"', 's."timestamp"')} AS created_at, r.hit_id, r.url, r.metadata,
        r.hit_created_at
      FROM latest s LEFT JOIN (SELECT *, '{{}}' AS metadata FROM score_log) r ON s.search_id = r.search_id""",
    "searches_with_scores": f"""WITH {SQL_LOG} SELECT {_VIEW.replace('s."timestamp"', _TIME + ' AS "timestamp"')} FROM search_log s
      LEFT JOIN score_log r ON s.search_id = r.search_id""",
    "daily_analytics": f"""WITH {SQL_LOG} SELECT strftime("timestamp", '%Y-%m-%d') AS search_date,
      count(DISTINCT search_id) AS total_searches, count(DISTINCT query) AS unique_queries,
      round(avg(num_results), 6) AS avg_results_requested,
      count(CASE WHEN search_type = 'summary' THEN 1 END) AS summary_searches,
      count(CASE WHEN search_type = 'detailed' THEN 1 END) AS detailed_searches,
      count(CASE WHEN feedback_success = 'y' THEN 1 END) AS successful_feedback,
      count(CASE WHEN feedback_success = 'n' THEN 1 END) AS unsuccessful_feedback
      FROM search_log GROUP BY 1""",
    "top_entities": f"""WITH {SQL_LOG} SELECT restaurant_id, restaurant_name, city, state,
      count(DISTINCT s.search_id) AS search_count,
      round(avg(similarity_score), 6) AS avg_similarity_score, round(avg(rank), 6) AS avg_rank
      FROM score_log r JOIN search_log s ON r.search_id = s.search_id GROUP BY ALL
      ORDER BY search_count DESC, restaurant_id, restaurant_name, city, state LIMIT 10""",
    "check_constraints": _FLAWED + f"rules AS ({_rules('s', 'r')}) SELECT * FROM rules",
    "column_defaults": f"""WITH {SQL_LOG} SELECT search_id, restaurant_id, rank,
      coalesce(honor_roll, 'n') AS honor_roll, coalesce(recommend, 'n') AS recommend,
      true AS has_id, true AS has_time FROM score_log""",
    "cascade_delete": f"""WITH {SQL_LOG} SELECT restaurant_id AS key, count(*) AS n FROM score_log
      WHERE search_id NOT IN (SELECT search_id FROM search_log WHERE feedback_success = 'n')
      GROUP BY restaurant_id UNION ALL SELECT search_type, count(*) FROM search_log
      WHERE feedback_success IS DISTINCT FROM 'n' GROUP BY search_type""",
    "contract_report": f"""WITH {SQL_LOG}, rules AS ({_rules('search_log', 'score_log')})
      SELECT * FROM (VALUES {_COLUMN_ROWS}) v(table_name, object_type, object_name, definition)
      UNION ALL SELECT "table", 'constraint', type || ' ' || rule,
        CASE WHEN violations = 0 THEN 'holds' ELSE 'broken' END || ': ' || violations FROM rules
      UNION ALL SELECT 'searches_with_scores', 'view', 'searches_with_scores',
        '25 columns, rows: ' || count(*) FROM search_log s LEFT JOIN score_log r
        ON s.search_id = r.search_id
      UNION ALL SELECT 'daily_analytics', 'materialized view', 'daily_analytics',
        'Is populated: ' || (count(*) > 0)::VARCHAR FROM search_log""",
    "feedback_merge": f"""WITH {SQL_LOG}, f AS (
        SELECT 'run-' || (event_id // 2) * 3 AS run_id, ts,
          CASE WHEN event_type IN ('purchase', 'signup') THEN 'y' ELSE 'n' END AS ok,
          'note ' || event_id AS note FROM events),
      last AS (SELECT run_id, max_by(ok, ts) AS ok, max_by(note, ts) AS note FROM f GROUP BY run_id)
      SELECT search_id, langsmith_run_id, coalesce(ok, feedback_success) AS feedback_success,
        coalesce(note, feedback_reason) AS feedback_reason
      FROM search_log LEFT JOIN last ON run_id = langsmith_run_id""",
    "required_columns": """SELECT * FROM (
      SELECT 'guide' AS table_name, 'title' AS column_name, true AS present, count(s_name) AS filled FROM supplier
      UNION ALL SELECT 'guide', 'State', false, 0
      UNION ALL SELECT 'directory', 'Restaurant', true, count(s_name) FROM supplier
      UNION ALL SELECT 'directory', 'State', true, count(s_nationkey) FROM supplier
      UNION ALL SELECT 'directory', 'sig_item', true, count(*) FILTER (WHERE s_suppkey % 6 <> 0) FROM supplier)""",
}
