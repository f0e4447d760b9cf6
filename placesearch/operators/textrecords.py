"""Marked guidebook texts -> records.

One row is one document.  Its fields are cut into records with array functions and only then
exploded, so no step shuffles, whatever the number of documents from one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placesearch.functions.marking import FIELDS, field_array, mark_document, tagged_values
from placesearch.functions.text import bind, collapse, collapse_lines
from placesearch.operators.rows import explode_once

SINGLE_FIELDS = tuple(f for f in FIELDS if f != "content")


def mark_texts(books: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with all field tags set."""
    return books.select("doc_id", mark_document(F.col("text")).alias("text"))


def find_values(marked: DataFrame, field: str) -> DataFrame:
    """One row per tagged value of ``field``: ``doc_id, pos, value``."""
    return explode_once(marked, ["doc_id"], tagged_values(F.col("text"), field), "value")


def field_stream(marked: DataFrame) -> DataFrame:
    """Every tagged field in document order: ``doc_id, pos, field, value``."""
    return explode_once(marked, ["doc_id"], field_array(F.col("text")), "f").select(
        "doc_id", "pos", "f.field", "f.value")


def _title_positions(fields: Column) -> Column:
    numbered = F.transform(fields, lambda f, i: F.struct(f["field"].alias("field"),
                                                         (i + 1).alias("pos")))
    return F.transform(F.filter(numbered, lambda f: f["field"] == "title"), lambda f: f["pos"])


def _cut(fields: Column, starts: Column) -> Column:
    """Slices of ``fields`` from each start to the next one."""
    return F.transform(starts, lambda s, i: F.slice(
        fields, s, F.coalesce(F.get(starts, i + 1), F.size(fields) + 1) - s))


def _extraction_starts(fields: Column) -> Column:
    # fields before the first title belong to the first record
    return bind(_title_positions(fields), lambda t: F.when(
        F.size(t) <= 1, F.array(F.lit(1))).otherwise(
            F.concat(F.array(F.lit(1)), F.slice(t, F.lit(2), F.size(t) - 1))))


def _validation_starts(fields: Column) -> Column:
    # fields before the first title are a sequence of their own
    return F.array_distinct(F.concat(F.array(F.lit(1)), _title_positions(fields)))


def _sequences(marked: DataFrame, starts) -> DataFrame:
    cut = bind(field_array(F.col("text")), lambda fields: F.when(
        F.size(fields) > 0, bind(starts(fields), lambda s: _cut(fields, s))))
    return explode_once(marked, ["doc_id"], cut, "fields").select(
        "doc_id", (F.col("pos") + 1).alias("rec"), "fields")


def record_ids(marked: DataFrame) -> DataFrame:
    """Each field with the number of the record it belongs to."""
    return (_sequences(marked, _extraction_starts)
            .select("doc_id", "rec", F.posexplode("fields").alias("pos", "f"))
            .select("doc_id", "rec", "pos", "f.field", "f.value"))


def _values(field: str) -> Column:
    return F.transform(F.filter("fields", lambda f: f["field"] == field), lambda f: f["value"])


def extract_records(marked: DataFrame) -> DataFrame:
    """One row per place that has a title and an address.

    The last value of a repeated field wins; content blocks are joined by a blank.
    """
    single = [collapse(F.try_element_at(_values(f), F.lit(-1))).alias(f) for f in SINGLE_FIELDS]
    content = collapse_lines(F.array_join(F.transform(_values("content"), collapse_lines), " "))
    records = _sequences(marked, _extraction_starts).select(
        "doc_id", "rec", *single, content.alias("content"))
    return records.filter((F.col("title") != "") & (F.col("address") != ""))


def validate_records(marked: DataFrame) -> DataFrame:
    """The first broken rule of each record that breaks one."""
    kinds = F.transform("fields", lambda f: f["field"])
    once = F.filter(kinds, lambda k: k != "content")
    sequences = _sequences(marked, _validation_starts).select(
        "doc_id", F.col("rec").alias("seq"),
        F.coalesce(F.get(_values("title"), F.lit(0)), F.lit("Unknown Title")).alias("title"),
        kinds.alias("kinds"), once.alias("once"))
    error = (F.when(F.get("kinds", F.lit(0)) != "title", "does not start with title")
             .when(~F.array_contains(F.slice("kinds", 2, 3), "address"), "missing address")
             .when(~F.array_contains("kinds", "content"), "missing content")
             .when(F.size(F.array_distinct("once")) < F.size("once"), "duplicate field"))
    return (sequences.withColumn("error", error).filter(F.col("error").isNotNull())
            .select("doc_id", "seq", "title", "error"))


def field_counts(marked: DataFrame) -> DataFrame:
    """How many values of each field were tagged."""
    return field_stream(marked).groupBy("field").agg(F.count("*").alias("n"))
