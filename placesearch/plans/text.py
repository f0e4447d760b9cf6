"""Registered queries: text to records."""

from __future__ import annotations

from pyspark.sql import functions as F

from placesearch.functions import marking as m
from placesearch.operators import textrecords as rec
from placesearch.plans.inputs import (
    SQL_LINE_TEXTS, SQL_PLACES, books, line_texts, sql_list, table,
)
from placesearch.functions.lexicon import STATE_LINES
from placesearch.session import spread


def _line_rule(rule):
    return lambda spark, d: line_texts(spark, d).select(
        "doc_id", rule(F.col("text")).alias("text"))


def _marked(spark, d):
    return rec.mark_texts(books(spark, d))


def _found(field):
    return lambda spark, d: rec.find_values(_marked(spark, d), field)


def _trimmed(spark, d):
    return line_texts(spark, d).select(
        "doc_id", m.left_trim_lines(m.normalize_quotes(F.col("text"))).alias("text"))


QUERIES = {
    "normalize_quotes": _line_rule(m.normalize_quotes),
    "left_trim_lines": _line_rule(m.left_trim_lines),
    "drop_state_lines": _line_rule(m.drop_state_lines),
    "strip_question_prefix": _line_rule(m.strip_question_prefix),
    "mark_urls": _line_rule(m.mark_urls),
    "mark_phones": _line_rule(m.mark_phones),
    "mark_hours": _line_rule(m.mark_hours),
    "mark_titles": _line_rule(m.mark_titles),
    "mark_cost": lambda spark, d: _trimmed(spark, d).select(
        "doc_id", m.mark_cost(m.mark_hours(F.col("text"))).alias("text")),
    "mark_remaining_content": lambda spark, d: _trimmed(spark, d).select(
        "doc_id", m.mark_remaining_content(m.mark_phones(F.col("text"))).alias("text")),
    "mark_addresses": lambda spark, d: books(spark, d).select(
        "doc_id", m.mark_addresses(m.mark_urls(F.col("text"))).alias("text")),
    "title_spacing": lambda spark, d: _trimmed(spark, d).select(
        "doc_id", m.title_spacing(m.mark_titles(F.col("text"))).alias("text")),
    "find_titles": _found("title"),
    "find_addresses": _found("address"),
    "find_urls": _found("URL"),
    "field_counts": lambda spark, d: rec.field_counts(_marked(spark, d)),
    "field_stream": lambda spark, d: rec.field_stream(_marked(spark, d)),
    "record_ids": lambda spark, d: rec.record_ids(_marked(spark, d)),
    "extract_records": lambda spark, d: rec.extract_records(_marked(spark, d)),
    "validate_records": lambda spark, d: rec.validate_records(_marked(spark, d)),
    "mark_books": _marked,
    "mark_document": lambda spark, d: spread(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", m.mark_document(F.col("text")).alias("text")),
}


def _per_line(expr: str, source: str = "line_texts", where: str = "true") -> str:
    return f"""array_to_string(list_transform(list_filter(string_split(text, chr(10)),
      lambda x: {where}), lambda x: {expr}), chr(10))"""


def _sql_lines(expr: str, where: str = "true") -> str:
    return f"WITH {SQL_LINE_TEXTS} SELECT doc_id, {_per_line(expr, where=where)} AS text FROM line_texts"


_TRIM = r"""regexp_replace(translate(x, '‘’“”', '''''""'), '^[ \t]+', '')"""
_URL = r"""CASE WHEN regexp_matches(x, '^\s*\S{2,40}\.(com|biz|org|net|edu|coop)(/[\w\-.#]+)*/?\s*$')
  THEN '|URL start| ' || rtrim(trim(x), '/') || ' |URL end|' || chr(10) ELSE x END"""
_PHONE = r"""regexp_replace(x, '^\s*(\d{3}-\d{3}-\d{4}|No phone)', '|phone start| \1 |phone end|' || chr(10))"""
_HOURS = r"""regexp_replace(x, '^\s*((BLD |LD |BL |BD |B |L |D |\([^)]+\)).*?\${1,3})',
  '|hours start| \1 |hours end|' || chr(10))"""
# letters are compared by case mapping, not by a pattern
_TITLE = r"""CASE WHEN trim(x, ' ' || chr(9)) IN ('K. LAMAY''S') OR (trim(x, ' ' || chr(9)) NOT IN ('', 'B.J.') AND NOT contains(x, '|')
  AND x = upper(x) AND x <> lower(x)
  AND length(regexp_replace(string_split(trim(x, ' ' || chr(9)), ' ')[1], '[^\p{Lu}\p{Nd}]', '', 'g')) >= 2)
  THEN '|title start| ' || trim(x, ' ' || chr(9)) || ' |title end|' ELSE x END"""

_TRIMMED = f"trimmed AS (SELECT doc_id, {_per_line(_TRIM)} AS text FROM line_texts)"

# tags of one place, in the order of the book, with a running position in the book
_FIELD_ROWS = f"""WITH {SQL_PLACES},
book_fields AS (
  SELECT doc_id, key, f.k, f.field, f.value FROM (
    SELECT doc_id, key, n, unnest([
      {{'k': 1, 'field': 'title', 'value': title}},
      {{'k': 2, 'field': 'URL', 'value': url}},
      {{'k': 3, 'field': 'address', 'value': address}},
      {{'k': 4, 'field': 'phone', 'value': CASE WHEN two_phones THEN replace(phone, '-011-', '-010-') ELSE phone END}},
      {{'k': 5, 'field': 'phone', 'value': CASE WHEN two_phones THEN phone END}},
      {{'k': 6, 'field': 'hours', 'value': hours}},
      {{'k': 7, 'field': 'cost', 'value': cost}},
      {{'k': 8, 'field': 'content', 'value': content}}]) AS f
    FROM places) WHERE f.value IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, doc_id * 10 - 1, 0, 'content', 'ABOUT the book' FROM places),
stream AS (
  SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY key, k) - 1 AS pos, field,
    CASE field WHEN 'hours' THEN replace(value, 'LD |', 'LD')
      WHEN 'content' THEN replace(value, 'Worth the trip', chr(10) || 'Worth   the trip')
      ELSE value END AS value
  FROM book_fields)
"""


def _sql_found(field: str) -> str:
    return _FIELD_ROWS + f"""SELECT doc_id,
      (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INT AS pos, value
      FROM stream WHERE field = '{field}'"""


SQL = {
    "normalize_quotes": f"WITH {SQL_LINE_TEXTS} SELECT doc_id, "
                        "translate(text, '‘’“”', '''''\"\"') AS text FROM line_texts",
    "left_trim_lines": _sql_lines(r"regexp_replace(x, '^[ \t]+', '')"),
    "drop_state_lines": _sql_lines("x", f"NOT list_contains({sql_list(STATE_LINES)}, trim(x))"),
    "strip_question_prefix": _sql_lines(r"regexp_replace(x, '^\?\s*([A-Z])', '\1')"),
    "mark_urls": _sql_lines(_URL),
    "mark_phones": _sql_lines(_PHONE),
    "mark_hours": _sql_lines(_HOURS),
    "mark_titles": _sql_lines(_TITLE),
    "mark_cost": f"""WITH {SQL_LINE_TEXTS}, {_TRIMMED},
      hours AS (SELECT doc_id, {_per_line(_HOURS)} AS text FROM trimmed),
      moved AS (SELECT doc_id, regexp_replace(text, '\\|\\s*(\\${{1,3}})\\s*\\|hours end\\|',
        ' |hours end|' || chr(10) || '|cost start| \\1 |cost end|' || chr(10), 'g') AS text FROM hours)
      SELECT doc_id, {_per_line("CASE WHEN trim(x) IN ('$', '$$', '$$$') THEN "
                                "'|cost start| ' || trim(x) || ' |cost end|' ELSE x END")} AS text
      FROM moved""",
    "mark_remaining_content": f"""WITH {SQL_LINE_TEXTS}, {_TRIMMED},
      phones AS (SELECT doc_id, {_per_line(_PHONE)} AS text FROM trimmed),
      ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS no FROM phones),
      isl AS (SELECT *, contains(line, '|') AS tagged,
        sum(contains(line, '|')::INT) OVER (PARTITION BY doc_id ORDER BY no) AS g FROM ln),
      blk AS (SELECT doc_id, g, tagged, min(no) AS no,
        trim(string_agg(line, chr(10) ORDER BY no), ' ' || chr(10)) AS body
        FROM isl GROUP BY doc_id, g, tagged)
      SELECT p.doc_id, coalesce(string_agg(CASE WHEN tagged THEN
          (SELECT l.line FROM ln l WHERE l.doc_id = b.doc_id AND l.no = b.no)
          ELSE '|content start| ' || body || ' |content end|' END, chr(10) ORDER BY b.no), '') AS text
      FROM phones p LEFT JOIN blk b ON p.doc_id = b.doc_id AND (b.tagged OR b.body <> '')
      GROUP BY p.doc_id""",
    "mark_addresses": f"""WITH {SQL_PLACES}
      SELECT doc_id, 'Texas' || chr(10) || 'ABOUT the book' || chr(10) || string_agg(
        title || chr(10) || '|URL start| ' || url || ' |URL end|' || chr(10)
        || CASE WHEN address IS NULL THEN chr(10)
           ELSE '|address start| ' || address || ' |address end|' || chr(10) || chr(10) END
        || CASE WHEN two_phones THEN replace(phone, '-011-', '-010-') || chr(10) ELSE '' END
        || coalesce(phone || chr(10), '')
        || CASE WHEN key % 2 = 0 THEN 'LD | $$' ELSE 'LD limited $' || chr(10) || '$$$' END
        || coalesce(chr(10) || replace(content, 'Worth the trip', chr(10) || '  Worth   the trip'), ''),
        chr(10) ORDER BY key) AS text
      FROM places GROUP BY doc_id""",
    "title_spacing": f"""WITH {SQL_LINE_TEXTS}, {_TRIMMED},
      titles AS (SELECT doc_id, string_split({_per_line(_TITLE)}, '|title start|') AS p FROM trimmed)
      SELECT doc_id, CASE WHEN len(p) = 1 THEN p[1] ELSE
        regexp_replace(p[1], '\\n+$', chr(10)) || '|title start|' || array_to_string(list_transform(p[2:],
          lambda x, i: CASE WHEN i = len(p) - 1 THEN x ELSE rtrim(x, chr(10)) END),
          chr(10) || chr(10) || '|title start|') END AS text
      FROM titles""",
    "find_titles": _sql_found("title"),
    "find_addresses": _sql_found("address"),
    "find_urls": _sql_found("URL"),
    "field_counts": _FIELD_ROWS + "SELECT field, count(*) AS n FROM stream GROUP BY field",
    "field_stream": _FIELD_ROWS + "SELECT doc_id, pos::INT AS pos, field, value FROM stream",
    "record_ids": _FIELD_ROWS + """, r AS (SELECT *, greatest(1, sum((field = 'title')::INT)
        OVER (PARTITION BY doc_id ORDER BY pos))::INT AS rec FROM stream)
      SELECT doc_id, rec, (row_number() OVER (PARTITION BY doc_id, rec ORDER BY pos) - 1)::INT AS pos,
        field, value FROM r""",
    "mark_books": _FIELD_ROWS + """SELECT doc_id, string_agg(
        CASE WHEN field = 'title' AND pos > 1 THEN chr(10) ELSE '' END || '|' || field || ' start| '
        || CASE WHEN value = 'LD' THEN 'LD ' ELSE value END || ' |' || field || ' end|',
        chr(10) ORDER BY pos) AS text FROM stream GROUP BY doc_id""",
    "extract_records": f"""WITH {SQL_PLACES}
      SELECT doc_id, n::INT AS rec, title, url AS "URL", address, phone,
        CASE WHEN key % 2 = 0 THEN 'LD' ELSE hours END AS hours, cost,
        CASE WHEN n = 1 THEN 'ABOUT the book' || coalesce(' ' || content, '')
          ELSE coalesce(content, '') END AS content
      FROM places WHERE address IS NOT NULL""",
    "validate_records": _FIELD_ROWS + """
      SELECT doc_id, 1 AS seq, 'Unknown Title' AS title, 'does not start with title' AS error
        FROM places GROUP BY doc_id
      UNION ALL SELECT doc_id, (n + 1)::INT, title,
        CASE WHEN address IS NULL THEN 'missing address' WHEN content IS NULL THEN 'missing content'
          ELSE 'duplicate field' END
      FROM places WHERE address IS NULL OR content IS NULL OR two_phones""",
}
