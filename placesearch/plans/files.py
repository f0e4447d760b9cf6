"""Registered queries: sources and sinks, as round trips through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from placesearch.functions.marking import normalize_quotes
from placesearch.operators import searchlog as log, textrecords as rec, trainset as tr
from placesearch.plans.inputs import (
    SQL_DIRECTORY, SQL_ENRICHED, SQL_LINE_TEXTS, SQL_LOG, SQL_PLACES, SQL_TURNS, books, chat_lines,
    directory, enriched, line_texts, score_log, search_log, turns,
)
from placesearch.plans.text import SQL as TEXT_SQL
from placesearch.plans.training import SQL as TRAINING_SQL
from placesearch.session import shared_folder
from placesearch.sources import files


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/placesearch-{uuid.uuid4().hex}"


def _records_csv(spark, d):
    path = new_folder(spark)
    files.write_records_csv(enriched(spark, d), path)
    return files.read_records_csv(
        spark, path, "row_id long, Restaurant string, content string, sig_item string, summary_q string")


def _extracted_csv(spark, d):
    path = new_folder(spark)
    records = rec.extract_records(rec.mark_texts(books(spark, d)))
    files.write_records_csv(records.select("title", "URL", "address", "phone", "hours", "cost",
                                           "content"), path)
    return files.read_records_csv(spark, path)


def _chat_lines(spark, d):
    path = new_folder(spark)
    chat_lines(spark, d).select("value").write.text(path)
    return files.read_chat_jsonl(spark, path).groupBy("readable").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") == "[1, 2]").alias("lists"))


def _directory(spark, d):
    path = new_folder(spark)
    wanted = directory(spark, d).withColumn("10th Ed.", F.when(F.col("ID") % 2 == 0, "y"))
    files.write_records_csv(wanted.select(
        "ID", "Restaurant", "State", "City", "Address", "Region", "Crossout", "Honor Roll",
        "Recommend", "long", "lat", "geohash", "`10th Ed.`"), path)
    return files.read_directory(spark, path)


def _book_text(spark, d):
    path = new_folder(spark)
    files.write_book_text(books(spark, d), path)
    read = files.read_book_text(spark, path)
    number = F.regexp_extract("doc_id", r"doc_id=(\d+)", 1).cast("long")
    return read.select(number.alias("doc_id"), "text")


def _marked_text(spark, d):
    path = new_folder(spark)
    files.write_marked_text(line_texts(spark, d).select(
        normalize_quotes(F.col("text")).alias("text")), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(
        F.count("*").alias("n"))


def _chat(spark, d):
    path = new_folder(spark)
    examples = tr.to_messages(tr.eligible_examples(turns(spark, d)))
    files.write_chat_jsonl(tr.train_test_split(examples, "example_id"), path)
    return files.read_chat_jsonl(spark, path).select("value", "split", "readable")


def _log(spark, d):
    path = new_folder(spark)
    searches, scores = search_log(spark, d), score_log(spark, d)
    early, first = F.col("timestamp") < "2024-01-15", F.col("rank") < 4
    files.append_search_log(searches.filter(early), scores.filter(first), path, "early")
    for _ in range(2):      # as when a job is run again
        files.append_search_log(searches.filter(~early), scores.filter(~first), path, "late")
    stored, hits = files.read_search_log(spark, path)
    return log.searches_with_scores(stored, hits).groupBy("search_id", "num_results").agg(
        F.count("rank").alias("hits"))


def _index(spark, d):
    path = new_folder(spark)
    wanted = directory(spark, d).select("ID", "Restaurant", F.col("content").alias("page_content"))
    files.build_index_if_absent(wanted, path)
    return files.build_index_if_absent(wanted.withColumn("Restaurant", F.lit("late")), path)


QUERIES = {
    "read_records_csv": _records_csv,
    "write_records_csv": _extracted_csv,
    "read_chat_jsonl": _chat_lines,
    "read_directory": _directory,
    "read_book_text": _book_text,
    "write_marked_text": _marked_text,
    "write_chat_jsonl": _chat,
    "append_search_log": _log,
    "build_index_if_absent": _index,
}

_CELL = "CASE WHEN {0} NOT IN (" + ", ".join(f"'{w}'" for w in files.NOTHING) + ") THEN {0} END AS {0}"

SQL = {
    "read_records_csv": f"""WITH {SQL_ENRICHED} SELECT row_id, "Restaurant",
      {_CELL.format('content')}, {_CELL.format('sig_item')}, {_CELL.format('summary_q')} FROM enriched""",
    "write_records_csv": f"""SELECT title, "URL", address, phone, hours, cost,
      nullif(content, '') AS content FROM ({TEXT_SQL['extract_records']})""",
    "read_chat_jsonl": f"""WITH {SQL_TURNS} SELECT kind <> 11 AS readable, count(*) AS n,
      count(*) FILTER (WHERE kind = 5) AS lists FROM turns GROUP BY kind <> 11""",
    "read_directory": f"""WITH {SQL_DIRECTORY} SELECT "ID", "Restaurant", "State", "City", "Address",
      "Region", "Crossout", "Honor Roll", "Recommend", long, lat, geohash,
      CASE WHEN "ID" % 2 = 0 THEN 'y' END AS "10th Ed." FROM directory""",
    "read_book_text": f"""WITH {SQL_PLACES}
      SELECT doc_id, 'Texas' || chr(10) || 'ABOUT the book' || chr(10) || string_agg(concat_ws(chr(10),
        title, url, address, CASE WHEN two_phones THEN replace(phone, '-011-', '-010-') END, phone,
        CASE WHEN key % 2 = 0 THEN 'LD | $$' ELSE 'LD limited $' || chr(10) || '$$$' END,
        replace(content, 'Worth the trip', chr(10) || '  Worth   the trip')), chr(10) ORDER BY key)
        || chr(10) AS text FROM places GROUP BY doc_id""",
    "write_marked_text": f"""WITH {SQL_LINE_TEXTS}, l AS (SELECT unnest(string_split(
        translate(text, '‘’“”', '''''""'), chr(10))) AS line FROM line_texts)
      SELECT line, count(*) AS n FROM l GROUP BY line""",
    "write_chat_jsonl": f"""WITH m AS ({TRAINING_SQL['to_messages']}),
      s AS ({TRAINING_SQL['train_test_split']})
      SELECT value, split, true AS readable FROM m JOIN s USING (example_id)""",
    "append_search_log": f"""WITH {SQL_LOG} SELECT s.search_id, num_results, count(r.rank) AS hits
      FROM search_log s LEFT JOIN score_log r ON r.search_id = s.search_id
      GROUP BY s.search_id, num_results""",
    "build_index_if_absent": f"""WITH {SQL_DIRECTORY} SELECT "ID", "Restaurant",
      content AS page_content FROM directory""",
}
