"""Registered queries: enrichment bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from placesearch.operators import enrich as en
from placesearch.plans.inputs import SQL_ENRICHED, answers, enriched


def _ensured(spark, d):
    return en.ensure_columns(enriched(spark, d))


def _parsed(spark, d):
    return en.parse_answers(answers(spark, d))


BATCH = 40            # rows of the batch below; more wait at every size


QUERIES = {
    "ensure_columns": lambda spark, d: en.ensure_columns(
        enriched(spark, d).drop("summary_q")).drop("content"),
    "pending_rows": lambda spark, d: en.pending_rows(_ensured(spark, d)).drop("content"),
    "pending_batch": lambda spark, d: en.pending_rows(
        _ensured(spark, d), BATCH, en.rejected_answers(_parsed(spark, d))).drop("content"),
    "build_prompts": lambda spark, d: en.build_prompts(_ensured(spark, d)),
    "parse_answers": lambda spark, d: _parsed(spark, d).drop("answer"),
    "rejected_answers": lambda spark, d: en.rejected_answers(_parsed(spark, d)).select("row_id"),
    "merge_answers": lambda spark, d: en.merge_answers(
        _ensured(spark, d), _parsed(spark, d)).drop("content"),
}

_BEFORE, _REST = en.PROMPT.split("{name}")
_BETWEEN, _AFTER = _REST.split("{content}")
_OLD = "coalesce(sig_item, '') AS sig_item, coalesce(summary_q, '') AS summary_q"

SQL = {
    "ensure_columns": f"""WITH {SQL_ENRICHED} SELECT row_id, "Restaurant",
      coalesce(sig_item, '') AS sig_item, '' AS summary_q FROM enriched""",
    "pending_rows": f"""WITH {SQL_ENRICHED} SELECT row_id, "Restaurant", {_OLD} FROM enriched e
      WHERE coalesce(e.sig_item, '') = '' OR coalesce(e.summary_q, '') = ''""",
    "pending_batch": f"""WITH {SQL_ENRICHED}, f AS (
        SELECT row_id, count(*) AS failed FROM parsed WHERE NOT parsed GROUP BY row_id)
      SELECT row_id, "Restaurant", {_OLD} FROM enriched e LEFT JOIN f USING (row_id)
      WHERE coalesce(e.sig_item, '') = '' OR coalesce(e.summary_q, '') = ''
      ORDER BY coalesce(failed, 0), row_id LIMIT {BATCH}""",
    "build_prompts": f"""WITH {SQL_ENRICHED} SELECT row_id, '{_BEFORE}' || "Restaurant"
      || '{_BETWEEN}' || content || '{_AFTER}' AS prompt FROM enriched""",
    "parse_answers": f"WITH {SQL_ENRICHED} SELECT row_id, parsed, sig_item, summary_q FROM parsed",
    "rejected_answers": f"WITH {SQL_ENRICHED} SELECT row_id FROM parsed WHERE NOT parsed",
    "merge_answers": f"""WITH {SQL_ENRICHED} SELECT e.row_id, "Restaurant",
      CASE WHEN parsed THEN p.sig_item ELSE coalesce(e.sig_item, '') END AS sig_item,
      CASE WHEN parsed THEN p.summary_q ELSE coalesce(e.summary_q, '') END AS summary_q
      FROM enriched e LEFT JOIN parsed p ON p.row_id = e.row_id""",
}
