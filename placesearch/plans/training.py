"""Registered queries: training-set preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from placesearch.operators import trainset as tr
from placesearch.plans.inputs import SQL_TURNS, chat_lines, turns


def _eligible(spark, d):
    return tr.eligible_examples(turns(spark, d))


def _lengths(spark, d):
    return tr.token_lengths(tr.typed_examples(chat_lines(spark, d, defects=False)))


def _messages(spark, d):
    return tr.to_messages(_eligible(spark, d)).select(
        "example_id", F.to_json(F.struct("messages")).alias("value"))


def _split(spark, d):
    return tr.train_test_split(_eligible(spark, d), "example_id").select("example_id", "split")


def _split_ok(spark, d):
    sample = tr.seeded_sample(_eligible(spark, d), "example_id")
    return tr.split_counts_ok(tr.train_test_split(sample, "example_id"), tr.SAMPLE_SIZE)


def _spread(spark, d):
    return tr.distribution(_lengths(spark, d)).withColumns(
        {c: F.round(c, 6) for c in ("mean", "median", "p10", "p90")})


def _gated(defects):
    return lambda spark, d: tr.gated_profile(chat_lines(spark, d, defects)).withColumn(
        "value", F.round("value", 6))


QUERIES = {
    "eligible_examples": lambda spark, d: _eligible(spark, d).select(
        "example_id", "summary_q", "content"),
    "seeded_sample": lambda spark, d: tr.seeded_sample(_eligible(spark, d), "example_id").select(
        "example_id"),
    "to_messages": _messages,
    "train_test_split": _split,
    "split_counts_ok": _split_ok,
    "validate_format": lambda spark, d: tr.validate_format(chat_lines(spark, d)),
    "validate_examples": lambda spark, d: tr.validate_examples(chat_lines(spark, d)),
    "missing_roles": lambda spark, d: tr.missing_roles(
        tr.typed_examples(chat_lines(spark, d, defects=False))),
    "token_lengths": _lengths,
    "distribution": _spread,
    "too_long": lambda spark, d: tr.too_long(_lengths(spark, d)),
    "training_cost": lambda spark, d: tr.training_cost(_lengths(spark, d)),
    "gated_profile": _gated(False),
    "gated_profile_closed": _gated(True),
}

_ELIGIBLE = f"""WITH {SQL_TURNS}, eligible AS (
  SELECT example_id, summary_q, content, md5('{tr.SEED}:' || example_id) AS o FROM turns
  WHERE "Crossout" IS DISTINCT FROM 'y' AND summary_q <> '' AND coalesce(content, '') <> '')
"""


def _tokens(text: str) -> str:
    return rf"len(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+'))"


_LENGTHS = f"""WITH {SQL_TURNS}, lengths AS (
  SELECT example_id, role, next_role, CASE WHEN content IS NULL THEN 3 ELSE 4 END AS n_messages,
    3 + (3 + 1 + 5) + (3 + 1 + 2) + (3 + 1 + {_tokens('summary_q')})
      + CASE WHEN content IS NULL THEN 0 ELSE 3 + 1 + {_tokens('content')} END
      + CASE WHEN example_id % 2 = 0 THEN 1 + 1 + 5 + 1 ELSE 0 END AS n_tokens,
    2 + CASE WHEN role = 'assistant' THEN {_tokens('summary_q')} ELSE 0 END
      + CASE WHEN next_role = 'assistant' THEN {_tokens('content')} ELSE 0 END AS n_assistant_tokens
  FROM turns)
"""
_ERR = """
  (kind = 11)::BIGINT AS unreadable_line, (kind = 5)::BIGINT AS data_type,
  (kind IN (4, 6))::BIGINT AS missing_messages_list, (kind = 7)::BIGINT AS message_missing_key,
  (kind = 1)::BIGINT AS message_unrecognized_key, (kind IN (2, 10))::BIGINT AS unrecognized_role,
  (kind IN (3, 7, 9, 10))::BIGINT AS missing_content,
  (kind NOT IN (4, 5, 6, 11) AND role <> 'assistant' AND coalesce(next_role, '') <> 'assistant')::BIGINT
    AS example_missing_assistant_message"""
_COST = """SELECT count(*) AS examples, sum(least(16385, n_tokens))::BIGINT AS tokens,
  (CASE WHEN count(*) * 3 < 100 THEN least(25, 100 // count(*))
    WHEN count(*) * 3 > 25000 THEN greatest(1, 25000 // count(*)) ELSE 3 END)::INT AS epochs
  FROM lengths"""


def _spread_sql(c: str, label: str) -> str:
    return f"""SELECT '{label}' AS measure, min({c})::INT AS min, max({c})::INT AS max,
      round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median,
      round(quantile_cont({c}, 0.1), 6) AS p10, round(quantile_cont({c}, 0.9), 6) AS p90
      FROM lengths"""


_SPREAD = " UNION ALL ".join(_spread_sql(c, label) for c, label in tr.MEASURES.items())

SQL = {
    "eligible_examples": _ELIGIBLE + "SELECT example_id, summary_q, content FROM eligible",
    "seeded_sample": _ELIGIBLE + "SELECT example_id FROM eligible ORDER BY o LIMIT 250",
    "to_messages": _ELIGIBLE + f"""SELECT example_id, to_json({{'messages': [
      {{'role': 'system', 'content': '{tr.SYSTEM_PROMPT}'}}, {{'role': 'user', 'content': summary_q}},
      {{'role': 'assistant', 'content': content}}]}})::VARCHAR AS value FROM eligible""",
    "train_test_split": _ELIGIBLE + """SELECT example_id, CASE WHEN row_number() OVER (ORDER BY o)
      <= ceil((SELECT count(*) FROM eligible) * 0.2) THEN 'test' ELSE 'train' END AS split FROM eligible""",
    "split_counts_ok": _ELIGIBLE + """, n AS (SELECT least(250, count(*)) AS n FROM eligible)
      SELECT (n - ceil(n * 0.2))::BIGINT AS train_rows, ceil(n * 0.2)::BIGINT AS test_rows,
        abs(n - ceil(n * 0.2) - 200) <= 1 AND abs(ceil(n * 0.2) - 50) <= 1 AS ok FROM n""",
    "validate_format": f"WITH {SQL_TURNS}, e AS (SELECT {_ERR} FROM turns) " + " UNION ALL ".join(
        f"SELECT '{e}' AS error, sum({e})::BIGINT AS n FROM e" for e in tr.ERRORS),
    "validate_examples": f"WITH {SQL_TURNS} SELECT example_id, {_ERR} FROM turns",
    "missing_roles": f"""WITH {SQL_TURNS} SELECT 0::BIGINT AS missing_system,
      count(*) FILTER (WHERE role <> 'user' AND coalesce(next_role, '') <> 'user') AS missing_user
      FROM turns""",
    "token_lengths": _LENGTHS + """SELECT example_id, n_messages, n_tokens::INT AS n_tokens,
      n_assistant_tokens::INT AS n_assistant_tokens FROM lengths""",
    "distribution": _LENGTHS + _SPREAD,
    "too_long": _LENGTHS + "SELECT count(*) FILTER (WHERE n_tokens > 16385) AS too_long FROM lengths",
    "training_cost": _LENGTHS + f"SELECT *, epochs * tokens AS billed_tokens FROM ({_COST})",
    "gated_profile": _LENGTHS + f""", cost AS (SELECT *, epochs * tokens AS billed_tokens FROM ({_COST})),
      spread AS ({_SPREAD}), all_rows AS (
      SELECT measure || '/' || k AS measure, v AS value FROM (SELECT measure,
        unnest(['min', 'max', 'mean', 'median', 'p10', 'p90']) AS k,
        unnest([min::DOUBLE, max::DOUBLE, mean, median, p10, p90]) AS v FROM spread)
      UNION ALL SELECT unnest(['examples', 'tokens', 'epochs', 'billed_tokens']),
        unnest([examples::DOUBLE, tokens::DOUBLE, epochs::DOUBLE, billed_tokens::DOUBLE]) FROM cost
      UNION ALL SELECT 'too_long', count(*) FILTER (WHERE n_tokens > 16385) FROM lengths
      UNION ALL SELECT 'missing_system', 0
      UNION ALL SELECT 'missing_user', count(*) FILTER (WHERE role <> 'user'
        AND coalesce(next_role, '') <> 'user') FROM turns)
      SELECT measure, round(value, 6) AS value FROM all_rows""",
    "gated_profile_closed": f"""WITH {SQL_TURNS} SELECT '' AS measure, 0.0::DOUBLE AS value FROM turns
      WHERE NOT EXISTS (SELECT 1 FROM turns WHERE kind BETWEEN 1 AND 11 AND kind <> 8)""",
}
