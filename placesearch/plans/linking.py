"""Registered queries: record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from placesearch.functions.names import merge_key
from placesearch.operators import linkage as ln
from placesearch.plans.inputs import SQL_LINKAGE, guide, sheet
from placesearch.session import spread


def _guide(spark, d):
    # a small file of repeated names is one split but many pairs, which no single task should make
    return ln.with_state(ln.rename_on_read(spread(guide(spark, d))))


def _exact(spark, d):
    return ln.exact_link(_guide(spark, d), sheet(spark, d))


def _done(spark, d):
    return ln.link(_guide(spark, d), sheet(spark, d))


def _unused(spark, d):
    return ln.unused_directory(sheet(spark, d), _exact(spark, d))


def _best(spark, d):
    return ln.best_match(_guide(spark, d), sheet(spark, d))


def _match_columns(best):
    return best.select("row_id", F.round("score", 6).alias("score"),
                       F.col("candidate.ID").alias("ID"),
                       F.col("candidate.Restaurant").alias("Restaurant"))


def _candidates(spark, d):
    rows = ln.blocked_candidates(sheet(spark, d))
    return rows.select("State", "name", "position", "candidate.*")


def _high_pass(spark, d):
    """The parts of the exact pass and what the high pass accepts of them."""
    exact = ln.exact_parts(_guide(spark, d), sheet(spark, d))
    return exact, ln.fuzzy_pass(exact.open, ln.unused_directory(sheet(spark, d), exact.used), ln.HIGH)


def _high(spark, d):
    return _match_columns(_high_pass(spark, d)[1])


def _patched(spark, d):
    exact, accepted = _high_pass(spark, d)
    # rows that the exact pass matched stay as they are
    return exact.matched.unionByName(ln.patch_linked(exact.open, accepted))


def _scores(spark, d):
    names = _guide(spark, d).select(
        "State", ln.token_sort(F.lower("title")).alias("left_key")).filter("State IS NOT NULL")
    best = ln.name_scores(names.distinct(), ln.blocked_candidates(sheet(spark, d)))
    return best.withColumn("score", F.round("score", 6))


def _unmatched_report(spark, d):
    report = ln.unmatched_report(_done(spark, d))
    return report.withColumn("Match_Score", F.round("Match_Score", 6))


def _summary(spark, d):
    return ln.pass_summary(guide(spark, d), _done(spark, d)).withColumn(
        "match_rate", F.round("match_rate", 6))


QUERIES = {
    "rename_on_read": lambda spark, d: ln.rename_on_read(guide(spark, d)),
    "extract_state": lambda spark, d: _guide(spark, d).select("row_id", "address_full", "State"),
    "state_coverage": lambda spark, d: ln.state_coverage(_guide(spark, d)),
    "merge_key": lambda spark, d: guide(spark, d).select(
        "row_id", merge_key(F.col("title")).alias("merge_key")),
    "exact_link": _exact,
    "link_columns": lambda spark, d: ln.link_columns(
        _exact(spark, d).select("row_id", "geohash", "title", "ID", "`Honor Roll`")),
    "completeness": lambda spark, d: ln.completeness(_exact(spark, d)).withColumn(
        "percent", F.round("percent", 6)),
    "unmatched_rows": lambda spark, d: ln.unmatched_rows(_exact(spark, d)).select(
        "row_id", "title", "State"),
    "unused_directory": _unused,
    "edition_filter": lambda spark, d: ln.edition_filter(_unused(spark, d)),
    "blocked_candidates": _candidates,
    "token_sort_ratio": _scores,
    "best_match": lambda spark, d: _match_columns(_best(spark, d)),
    "fuzzy_pass_high": _high,
    "fuzzy_pass_low": lambda spark, d: _match_columns(_done(spark, d).low),
    "patch_linked": _patched,
    "link_final": lambda spark, d: _done(spark, d).final,
    "unmatched_report": _unmatched_report,
    "unused_report": lambda spark, d: ln.unused_report(sheet(spark, d), _done(spark, d).used),
    "pass_summary": _summary,
}

_ROW = ", ".join(f'r."{c}"' for c in ("Restaurant", *ln.DIRECTORY_COLUMNS))
_LEFT = 'l.row_id, l.title, l."URL", l.address_full, l.phone, l.hours, l.cost, l.content, l."State"'
_SORTED = "array_to_string(list_sort(string_split(regexp_replace(trim(lower({0}), ' ' || chr(9)), '\\s+', ' ', 'g'), ' ')), ' ')"

_EXACT = f"""WITH {SQL_LINKAGE},
exact AS (
  SELECT {_LEFT}, {_ROW} FROM guide l LEFT JOIN sheet r
    ON trim(lower(l.title), ' ' || chr(9)) = lower(r."Restaurant")
    AND l."State" IS NOT DISTINCT FROM r."State"),
unused AS (SELECT * FROM sheet WHERE "ID" NOT IN (SELECT "ID" FROM exact WHERE "ID" IS NOT NULL)),
edition AS (SELECT * FROM unused WHERE "10th Ed." = 'y')
"""

# dynamic programming over characters; every step builds one row of the table
_LCS = """list_last(list_reduce(list_transform(string_split(a, ''), lambda c: [ascii(c)]),
  lambda prev, c: list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j::INT]),
    lambda row, j: list_append(row, CASE WHEN ascii(b[j[1]]) = c[1] THEN prev[j[1]] + 1
      ELSE greatest(prev[j[1] + 1], row[len(row)]) END), [0::INT]),
  list_transform(range(0, length(b) + 1), lambda i: 0::INT)))"""


def _pass(tag: str, rows: str, directory: str) -> str:
    """CTEs that score every unmatched row against every candidate of its state."""
    return f"""
{tag}_named AS (SELECT *, lower("Restaurant") AS name,
    min(row_no) OVER (PARTITION BY "State", lower("Restaurant")) AS position,
    row_number() OVER (PARTITION BY "State", lower("Restaurant") ORDER BY row_no DESC) AS last
  FROM {directory} WHERE "State" IS NOT NULL),
{tag}_cand AS (SELECT *, {_SORTED.format('name')} AS b FROM {tag}_named WHERE last = 1),
{tag}_left AS (SELECT row_id, "State", {_SORTED.format('title')} AS a FROM {rows}
  WHERE "State" IS NOT NULL),
{tag}_pairs AS (SELECT DISTINCT a, b FROM {tag}_left JOIN {tag}_cand USING ("State")),
{tag}_lcs AS (SELECT a, b, 200.0::DOUBLE * {_LCS} / (length(a) + length(b)) AS score FROM {tag}_pairs),
{tag}_best AS (
  SELECT row_id, l."State" AS best_state, a, score, position, {', '.join(f'c."{x}"' for x in ('Restaurant', *ln.DIRECTORY_COLUMNS))}
  FROM {tag}_left l JOIN {tag}_cand c USING ("State") JOIN {tag}_lcs USING (a, b)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, position) = 1)
"""


_HIGH = _EXACT + """, open AS (SELECT * FROM exact WHERE "ID" IS NULL), """ + _pass(
    "h", "open", "edition") + """,
high AS (SELECT * FROM h_best WHERE score >= 85)
"""
_BOTH = _HIGH + """,
open2 AS (SELECT * FROM open WHERE row_id NOT IN (SELECT row_id FROM high)),
edition2 AS (SELECT * FROM edition WHERE "ID" NOT IN (SELECT "ID" FROM high)),
""" + _pass("w", "open2", "edition2") + ", low AS (SELECT * FROM w_best WHERE score >= 25)"

_COLUMNS = ("Restaurant", *ln.DIRECTORY_COLUMNS)
_PATCH = ", ".join(f'CASE WHEN m.row_id IS NOT NULL AND l."ID" IS NULL THEN m."{c}" ELSE l."{c}" END AS "{c}"'
                   for c in _COLUMNS)
_FINAL = f"""final AS (SELECT {_LEFT}, {_PATCH} FROM exact l LEFT JOIN
  (SELECT * FROM high UNION ALL BY NAME SELECT * FROM low) m ON l.row_id = m.row_id)"""
_MATCH = 'SELECT row_id, round(score, 6) AS score, "ID", "Restaurant" FROM'
_ALL = ", ".join(f"count(\"{c}\") AS \"{c}\"" for c in ln.PROFILED)

SQL = {
    "rename_on_read": f'WITH {SQL_LINKAGE} SELECT * EXCLUDE "State" FROM guide',
    "extract_state": f'WITH {SQL_LINKAGE} SELECT row_id, address_full, "State" FROM guide',
    "state_coverage": f"""WITH {SQL_LINKAGE} SELECT count("State") AS with_state, count(*) AS total
      FROM guide""",
    "merge_key": f"""WITH {SQL_LINKAGE} SELECT row_id, trim(lower(title), ' ' || chr(9)) AS merge_key
      FROM guide""",
    "exact_link": _EXACT + "SELECT * FROM exact",
    "link_columns": _EXACT + 'SELECT "ID", title, "Honor Roll", geohash, row_id FROM exact',
    "completeness": _EXACT + " UNION ALL ".join(
        f"""{', n AS (SELECT count(*) AS n FROM exact) ' if i == 0 else ''}SELECT '{c}' AS column_name, count("{c}") AS filled,
        round(count("{c}") / any_value(n) * 100, 6) AS percent FROM exact, n"""
        for i, c in enumerate(ln.PROFILED)),
    "unmatched_rows": _EXACT + 'SELECT row_id, title, "State" FROM exact WHERE "ID" IS NULL',
    "unused_directory": _EXACT + "SELECT * FROM unused",
    "edition_filter": _EXACT + "SELECT * FROM edition",
    "blocked_candidates": f"""WITH {SQL_LINKAGE} SELECT "State", lower("Restaurant") AS name,
      min(row_no) AS position, {', '.join(f'last(s."{c}" ORDER BY row_no) AS "{c}"' for c in _COLUMNS)}
      FROM sheet s WHERE "State" IS NOT NULL GROUP BY "State", lower("Restaurant")""",
    "token_sort_ratio": f"WITH {SQL_LINKAGE}, " + _pass("g", "guide", "sheet")
    + 'SELECT DISTINCT best_state AS "State", a AS left_key, position, round(score, 6) AS score FROM g_best',
    "best_match": f"WITH {SQL_LINKAGE}, " + _pass("g", "guide", "sheet") + f"{_MATCH} g_best",
    "fuzzy_pass_high": _HIGH + f"{_MATCH} high",
    "fuzzy_pass_low": _BOTH + f"{_MATCH} low",
    "patch_linked": _HIGH + f"SELECT {_LEFT}, {_PATCH} FROM exact l LEFT JOIN high m ON l.row_id = m.row_id",
    "link_final": _BOTH + f", {_FINAL} SELECT * FROM final",
    "unmatched_report": _BOTH + f""", {_FINAL} SELECT round(b.score, 6) AS "Match_Score",
      b."Restaurant" AS "Best_Match", b.best_state AS "Excel_State", b."ID" AS "Excel_ID", f.*
      FROM final f LEFT JOIN h_best b ON f.row_id = b.row_id WHERE f."ID" IS NULL""",
    "unused_report": _BOTH + f""", {_FINAL} SELECT * FROM sheet WHERE "10th Ed." = 'y'
      AND "ID" NOT IN (SELECT "ID" FROM final WHERE "ID" IS NOT NULL)""",
    "pass_summary": _BOTH + """, n AS (SELECT count(*) AS total FROM guide),
      e AS (SELECT count("Restaurant") AS m, count(*) FILTER (WHERE "ID" IS NULL) AS o FROM exact),
      h AS (SELECT count(*) AS m FROM high), w AS (SELECT count(*) AS m FROM low)
      SELECT 1 AS pass_no, 'exact' AS pass, e.m AS matches, round(e.m / total * 100, 6) AS match_rate,
        e.o AS remaining FROM n, e
      UNION ALL SELECT 2, 'high', h.m, round((e.m + h.m) / total * 100, 6), e.o - h.m FROM n, e, h
      UNION ALL SELECT 3, 'low', w.m, round((e.m + h.m + w.m) / total * 100, 6), e.o - h.m - w.m
        FROM n, e, h, w""",
}
