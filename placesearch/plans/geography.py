"""Registered queries: geographic filters from query text."""

from __future__ import annotations

from pyspark.sql import functions as F

from placesearch.functions import geo
from placesearch.functions.lexicon import BROAD_REGIONS, REGION_ALIASES, state_aliases
from placesearch.operators import geofilter as gf
from placesearch.plans.inputs import (
    SQL_ASKED, SQL_DIRECTORY, asked, city_lists, condition_lists, directory, placed_vectors,
)

TREE = {"$or": [{"State": {"$in": ["TX", "LA", "MD"]}},
                {"$and": [{"City": "Town7"}, {"State": "AL"}]},
                {"Region": "Midwest", "Recommend": "n"}]}


def _extracted(column, field):
    def run(spark, d):
        found = column(F.col("text"))
        return asked(spark, d).select("query_id", F.array_join(found, ",").alias("found"),
                                      geo.in_condition(field, found).alias("condition"))
    return run


def _filters(spark, d):
    return gf.query_filters(asked(spark, d), placed_vectors(spark, d))


def _unique(spark, d):
    return condition_lists(spark, d).select(
        "query_id", geo.dedupe_conditions(F.col("conditions")).alias("conditions"))


def _search(spark, d):
    found = gf.filtered_search(gf.scope_gate(asked(spark, d)), placed_vectors(spark, d))
    return found.withColumn("distance", F.round("distance", 6))


QUERIES = {
    "state_filter": _extracted(geo.state_codes, "State"),
    "region_filter": _extracted(geo.region_names, "Region"),
    "broad_region_filter": _extracted(geo.broad_states, "State"),
    "city_filter": lambda spark, d: city_lists(spark, d).select(
        "query_id", geo.city_condition(F.col("cities")).alias("condition")),
    "city_lookup": lambda spark, d: gf.city_lookup(asked(spark, d), placed_vectors(spark, d)),
    "dedupe_conditions": lambda spark, d: _unique(spark, d).select(
        "query_id", F.array_join("conditions", ";").alias("conditions")),
    "combine_conditions": lambda spark, d: _unique(spark, d).select(
        "query_id", geo.combine_conditions(F.col("conditions")).alias("filter")),
    "query_filters": lambda spark, d: _filters(spark, d).select("query_id", "filter"),
    "clauses": lambda spark, d: gf.clauses(_filters(spark, d)),
    "where_predicate": lambda spark, d: directory(spark, d).filter(geo.where_predicate(TREE)).select(
        "ID", "City", "State", "Region", "Recommend"),
    "scope_gate": lambda spark, d: gf.scope_gate(asked(spark, d)).select("query_id", "answer"),
    "filtered_search": _search,
}


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


_LEXICON = f"""
aliases(alias, code) AS (VALUES {_values(state_aliases().items())}),
regions(alias, name) AS (VALUES {_values(REGION_ALIASES.items())}),
areas(alias, code) AS (VALUES {_values((a, s) for a, states in BROAD_REGIONS.items() for s in states)}),
texts AS (SELECT DISTINCT lower(text) AS t FROM asked),
hit_states AS (SELECT t, list_sort(list(DISTINCT code)) AS v FROM texts JOIN aliases
  ON regexp_matches(t, '\\b' || alias || '\\b') GROUP BY t),
hit_regions AS (SELECT t, list_sort(list(DISTINCT name)) AS v FROM texts JOIN regions
  ON regexp_matches(t, '\\b' || alias || '\\b') GROUP BY t),
hit_areas AS (SELECT t, list_sort(list(DISTINCT code)) AS v FROM texts JOIN areas
  ON regexp_matches(t, '\\b' || alias || '\\b') WHERE t NOT IN (SELECT t FROM hit_regions) GROUP BY t)
"""
_BASE = f"WITH {SQL_ASKED}, {_LEXICON}"


def _sql_extracted(hits: str, field: str) -> str:
    return _BASE + f"""SELECT query_id, coalesce(array_to_string(v, ','), '') AS found,
      to_json({{'{field}': {{'$in': v}}}})::VARCHAR AS condition
      FROM (SELECT query_id, v, v IS NULL AS none FROM asked LEFT JOIN {hits} ON t = lower(text))"""


def _nullable(sql: str) -> str:
    return sql.replace("to_json(", "CASE WHEN none THEN NULL ELSE to_json(").replace(
        ")::VARCHAR AS condition", ")::VARCHAR END AS condition")


_TOWNS = """,
town_texts AS (SELECT DISTINCT "City", "State" FROM placed WHERE "State" IS NOT NULL),
found_towns AS (SELECT t, "City", "State",
    coalesce(list_contains(v, "State"), false) AS named
  FROM texts JOIN town_texts ON regexp_matches(t, '\\b' || lower("City") || '\\b')
  LEFT JOIN hit_states USING (t)),
towns AS (SELECT t, "City", "State" FROM found_towns
  QUALIFY named OR NOT bool_or(named) OVER (PARTITION BY t, "City"))
"""
_PARTS = _TOWNS + """,
town_lists AS (SELECT t, list('{"$and":[{"City":"' || "City" || '"},{"State":"' || "State" || '"}]}'
    ORDER BY "City", "State") AS c FROM (SELECT t, "City", "State" FROM towns) GROUP BY t),
conditions AS (
  SELECT t, 1 AS n, to_json({'State': {'$in': v}})::VARCHAR AS c FROM hit_states
  UNION ALL SELECT t, 2, to_json({'Region': {'$in': v}})::VARCHAR FROM hit_regions
  UNION ALL SELECT t, 3, to_json({'State': {'$in': v}})::VARCHAR FROM hit_areas
  UNION ALL SELECT t, 4, CASE WHEN len(c) = 1 THEN c[1] ELSE '{"$or":[' || array_to_string(c, ',') || ']}' END
    FROM town_lists),
once AS (SELECT t, c, min(n) AS n FROM conditions GROUP BY t, c),
filters AS (SELECT t, CASE WHEN count(*) = 1 THEN any_value(c)
  ELSE '{"$or":[' || string_agg(c, ',' ORDER BY n) || ']}' END AS filter FROM once GROUP BY t)
"""
_CLAUSES = _TOWNS + """,
parts AS (
  SELECT t, 1 AS n, 'State' AS field, v AS vs FROM hit_states
  UNION ALL SELECT t, 2, 'Region', v FROM hit_regions
  UNION ALL SELECT t, 3, 'State', v FROM hit_areas
  UNION ALL SELECT t, 4, 'City|State', list("City" || '|' || "State" ORDER BY "City", "State")
    FROM towns GROUP BY t),
flat AS (SELECT t, n, field, unnest(vs) AS value, generate_subscripts(vs, 1) AS i FROM parts),
first AS (SELECT t, field, value, min(n * 1000 + i) AS o FROM flat GROUP BY t, field, value)
"""
SQL = {
    "state_filter": _nullable(_sql_extracted("hit_states", "State")),
    "region_filter": _nullable(_sql_extracted("hit_regions", "Region")),
    "broad_region_filter": _nullable(_sql_extracted("hit_areas", "State")),
    "city_filter": """SELECT event_id AS query_id, CASE event_id % 5
      WHEN 1 THEN '{"$and":[{"City":"Town' || user_id || '"},{"State":"TX"}]}'
      WHEN 2 THEN '{"$or":[{"$and":[{"City":"Town' || user_id || '"},{"State":"TX"}]},{"City":"Port"}]}'
      WHEN 3 THEN '{"$or":[{"City":"Town' || user_id || '"},{"$and":[{"City":"Town' || user_id
        || '"},{"State":"MD"}]}]}' END AS condition FROM events""",
    "city_lookup": _BASE + _TOWNS + """SELECT query_id, "City", "State" FROM asked
      JOIN towns ON t = lower(text)""",
    "dedupe_conditions": """SELECT event_id AS query_id, CASE event_id % 4 WHEN 0 THEN ''
      WHEN 1 THEN '{"City":"Town' || user_id || '","State":"TX"}'
      WHEN 2 THEN '{"Region":{"$in":["b","a"]}};{"City":"Town' || user_id || '","State":"TX"}'
      ELSE '{"Region":{"$in":["a","b"]}};{"Region":{"$in":["b","a"]}}' END AS conditions FROM events""",
    "combine_conditions": """SELECT event_id AS query_id, CASE event_id % 4
      WHEN 1 THEN '{"City":"Town' || user_id || '","State":"TX"}'
      WHEN 2 THEN '{"$or":[{"Region":{"$in":["b","a"]}},{"City":"Town' || user_id || '","State":"TX"}]}'
      WHEN 3 THEN '{"$or":[{"Region":{"$in":["a","b"]}},{"Region":{"$in":["b","a"]}}]}' END AS filter
      FROM events""",
    "query_filters": _BASE + _PARTS + """SELECT query_id, filter FROM asked
      LEFT JOIN filters ON t = lower(text)""",
    "clauses": _BASE + _CLAUSES + """SELECT query_id, (row_number() OVER
      (PARTITION BY query_id ORDER BY o) - 1)::INT AS clause_no, field, value
      FROM asked JOIN first ON t = lower(text)""",
    "where_predicate": f"""WITH {SQL_DIRECTORY} SELECT "ID", "City", "State", "Region", "Recommend"
      FROM directory WHERE "State" IN ('TX', 'LA', 'MD') OR ("City" = 'Town7' AND "State" = 'AL')
      OR ("Region" = 'Midwest' AND "Recommend" = 'n')""",
    "scope_gate": f"""WITH {SQL_ASKED} SELECT query_id, answer FROM asked
      WHERE answer IS NULL OR upper(answer) LIKE '%IN\\_SCOPE%' ESCAPE '\\'""",
    "filtered_search": _BASE + _CLAUSES + """,
      gated AS (SELECT query_id, vec_id, lower(text) AS t FROM asked
        WHERE answer IS NULL OR contains(upper(answer), 'IN_SCOPE')),
      allowed AS (
        SELECT DISTINCT t, doc_id FROM first JOIN placed ON
          CASE field WHEN 'State' THEN "State" WHEN 'Region' THEN "Region"
            ELSE "City" || '|' || "State" END = value
        UNION ALL SELECT t, doc_id FROM texts, placed WHERE t NOT IN (SELECT t FROM first)),
      dists AS (SELECT a.vec_id, b.vec_id AS doc_id,
        list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
        FROM embeddings a CROSS JOIN embeddings b)
      SELECT query_id, doc_id, round(dist ** 2, 6) AS distance,
        row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id)::INT AS rank
      FROM gated JOIN allowed USING (t) JOIN dists USING (vec_id, doc_id) QUALIFY rank <= 4""",
}
