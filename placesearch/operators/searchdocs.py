"""Linked records -> search documents."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from placesearch.functions.lexicon import STATE_NAMES

# Columns of the linked records that a search document keeps.
READ_COLUMNS = ("ID", "Restaurant", "URL", "Address", "City", "State", "Region", "phone", "hours",
                "Crossout", "Honor Roll", "Recommend", "long", "lat", "geohash", "sig_item",
                "content")


def read_pruned(records: DataFrame) -> DataFrame:
    return records.select(*[F.col(f"`{c}`") for c in READ_COLUMNS])


def drop_crossed_out(records: DataFrame) -> DataFrame:
    """Keep the rows not marked ``y``; an unknown mark keeps the row."""
    return records.filter(~F.col("Crossout").eqNullSafe("y")).drop("Crossout")


def state_name(code: Column) -> Column:
    """Full name of a state code; null if unknown."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(STATE_NAMES.items())])
    return F.try_element_at(pairs, code)


def compose_document(records: DataFrame) -> DataFrame:
    """The text to embed, as ``page_content``; the other columns stay as metadata."""
    def known(column: str, default: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(default))

    named = records.withColumn("State Name", state_name(F.col("State")))
    return named.withColumn("page_content", F.concat(
        F.lit("Restaurant: "), known("Restaurant", "Unknown Restaurant"),
        F.lit("\nLocation: "), known("City", "Unknown City"), F.lit(", "),
        known("State Name", "Unknown State"),
        F.lit("\nSignature Item: "), known("sig_item", "Unknown Item"),
        F.lit("\n\n"), F.coalesce("content", F.lit("")))).drop("content")


def metadata_columns(documents: DataFrame, text: str = "page_content") -> DataFrame:
    """The text and, as one JSON object, every other column."""
    others = [F.col(f"`{c}`") for c in documents.columns if c not in (text, "embedding")]
    return documents.select(text, F.to_json(F.struct(*others)).alias("metadata"))


def build_documents(records: DataFrame) -> DataFrame:
    return compose_document(drop_crossed_out(read_pruned(records)))


def hit_report(hits: DataFrame) -> DataFrame:
    """A line per hit: the first line of its text, and its name and city."""
    return hits.select(
        "query_id", "rank", F.substring_index("page_content", "\n", 1).alias("first_line"),
        F.concat(F.coalesce("Restaurant", F.lit("Unknown")), F.lit(" in "),
                 F.coalesce("City", F.lit("Unknown"))).alias("place"))
