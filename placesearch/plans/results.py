"""Registered queries: result text."""

from __future__ import annotations

from pyspark.sql import functions as F

from placesearch.functions.answers import RULE, standardize_headline
from placesearch.operators import reports
from placesearch.plans.inputs import SQL_REQUESTS, requests, table


def searches(spark, d):
    """Requests with an answer that names each of their hits twice."""
    lines = F.transform("results", lambda r: F.concat(
        F.lit("Visit "), F.lower(r["Restaurant"]), F.lit(" now. Yes, "), r["Restaurant"],
        F.lit("!")))
    texts = F.transform("results", lambda r: r.withField("content", F.concat(
        r["sig_item"], F.lit("\nin "), r["City"])).withField(
            "URL", F.when(r["ID"] % 3 == 1, F.concat(F.lit("http://"), r["URL"]))
            .when(r["ID"] % 3 == 2, r["URL"])))
    texts = F.transform(texts, lambda r: r.withField("content", F.coalesce(
        r["content"], F.lit("$1 \\ plain"))))
    return requests(spark, d).select(
        F.col("langsmith_run_id").alias("search_id"), "query",
        F.concat(F.lit("## **Good** eats\n* "), F.array_join(lines, "\n* ")).alias("answer"),
        texts.alias("results"))


def headlines(spark, d):
    key, text = (F.col("conv_id") + F.col("turn")) % 6, F.col("text")
    body = (F.when(key == 0, F.concat(F.lit("# Title: "), text))
            .when(key == 1, F.concat(F.lit("\n\n## **Big** trip\n* item\n"), text))
            .when(key == 2, F.concat(F.lit("Catchy Title: Eat \n well\n\n"), text))
            .when(key == 3, F.concat(F.lit("**Bold** line\n- a\n"), text))
            .when(key == 4, F.lit("  \n "))
            .otherwise("headline: one line\n# Sub\n## Deep\n### Keep"))
    return table(spark, d, "conversations").select("conv_id", "turn", body.alias("text"))


QUERIES = {
    "join_contents": lambda spark, d: reports.contents(searches(spark, d)),
    "link_entities": lambda spark, d: reports.summaries(searches(spark, d)).select(
        "search_id", F.col("linked").alias("text")),
    "standardize_headline": lambda spark, d: headlines(spark, d).select(
        "conv_id", "turn", standardize_headline(F.col("text")).alias("text")),
    "results_report": lambda spark, d: reports.results_reports(searches(spark, d)),
    "summary_report": lambda spark, d: reports.summary_reports(
        reports.summaries(searches(spark, d))),
}

_CONTENT = "coalesce(sig_item || chr(10) || 'in ' || \"City\", '$1 \\ plain')"
_LINES = """string_agg('Visit ' || CASE "ID" % 3
    WHEN 1 THEN '[**' || "Restaurant" || '**](http://' || "URL" || ')'
    WHEN 2 THEN '[**' || "Restaurant" || '**](https://' || "URL" || ')'
    ELSE '**' || "Restaurant" || '**' END || ' now. Yes, **' || "Restaurant" || '**!',
    chr(10) || '* ' ORDER BY rank)"""

SQL = {
    "join_contents": f"""WITH {SQL_REQUESTS} SELECT 'run-' || event_id AS search_id,
      string_agg({_CONTENT}, chr(10) || chr(10) ORDER BY rank) AS contents
      FROM results GROUP BY event_id""",
    "link_entities": f"""WITH {SQL_REQUESTS} SELECT 'run-' || event_id AS search_id,
      '## **Good** eats' || chr(10) || '* ' || {_LINES} AS text FROM results GROUP BY event_id""",
    "standardize_headline": """WITH t AS (SELECT *, (conv_id + turn) % 6 AS k FROM conversations)
      SELECT conv_id, turn, CASE k WHEN 0 THEN '### ' || text
        WHEN 1 THEN '### Big trip' || chr(10) || chr(10) || '* item' || chr(10) || text
        WHEN 2 THEN '### Eat well' || chr(10) || chr(10) || chr(10) || text
        WHEN 3 THEN '### Bold line' || chr(10) || chr(10) || '- a' || chr(10) || text
        WHEN 4 THEN '  ' || chr(10) || ' '
        ELSE '### one line' || chr(10) || '### Sub' || chr(10) || '### Deep' || chr(10) || '### Keep' END
        AS text FROM t""",
    "results_report": f"""WITH {SQL_REQUESTS} SELECT 'run-' || r.event_id AS search_id,
      'Search query: ' || any_value(query) || chr(10) || chr(10) || string_agg('Result ' || rank || ':'
        || chr(10) || {_CONTENT} || chr(10) || '{RULE}' || chr(10) || chr(10), '' ORDER BY rank) AS report,
      string_agg('## Result ' || rank || ':' || chr(10) || chr(10) || {_CONTENT} || chr(10) || chr(10)
        || '---', chr(10) ORDER BY rank) AS page
      FROM results r JOIN requests q ON q.event_id = r.event_id GROUP BY r.event_id""",
    "summary_report": f"""WITH {SQL_REQUESTS}, s AS (SELECT 'run-' || r.event_id AS search_id,
      'Search query: ' || any_value(query) || chr(10) || chr(10) AS head,
      '### Good eats' || chr(10) || chr(10) || '* ' || {_LINES} AS body
      FROM results r JOIN requests q ON q.event_id = r.event_id GROUP BY r.event_id)
      SELECT search_id, head || 'SUMMARY:' || chr(10) || chr(10) || body AS report,
        head || body AS plain_report FROM s""",
}
