"""Bookkeeping around derived fields: what is missing, what to ask, what came back.

The answers themselves come from outside and arrive as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placesearch.functions.text import SPACE, gsub, strip
from placesearch.operators.selection import SMALL, first_rows
from placesearch.session import cut_lineage

# Derived columns and the answer's keys.
DERIVED = {"sig_item": "signature_item", "summary_q": "summary_question"}

PROMPT = """A guidebook says this about the restaurant "{name}":

{content}

Name the one dish it is known for, as briefly as possible, and write one question that this
text answers well.  Reply with a JSON object only, in this form:
{"signature_item": "the dish or style", "summary_question": "the question"}
"""


def ensure_columns(records: DataFrame) -> DataFrame:
    """The derived columns exist and are never null."""
    return records.withColumns({
        c: F.coalesce(F.col(c), F.lit("")) if c in records.columns else F.lit("")
        for c in DERIVED})


def pending_rows(records: DataFrame, limit: int | None = None,
                 rejected: DataFrame | None = None) -> DataFrame:
    """The rows that lack a derived field; with ``limit``, the next batch of so many.

    ``rejected``: a ``row_id`` per answer that could not be read.  A batch takes the rows with the
    fewest such answers first, then by row order, so bad answers never keep untried rows waiting.
    """
    lacking = records.filter((F.col("sig_item") == "") | (F.col("summary_q") == ""))
    if limit is None:
        return lacking
    failed = F.lit(0)
    if rejected is not None:
        counts = rejected.groupBy("row_id").agg(F.count("*").alias("_failed"))
        lacking, failed = lacking.join(counts, "row_id", "left"), F.coalesce("_failed", F.lit(0))
    tried = lacking.withColumn("_failed", failed)
    if limit <= SMALL or dict(records.dtypes)["row_id"] not in ("int", "bigint"):
        return tried.orderBy("_failed", "row_id").limit(limit).select(*records.columns)
    return tried.filter(_first_pending(tried.select("_failed", "row_id"), limit)).select(*records.columns)


def _first_pending(tried: DataFrame, limit: int) -> Column:
    """Whether a row is among the first ``limit``, by counts instead of a sort; ``row_id`` is unique."""
    tried = cut_lineage(tried)
    left = limit
    # one row per number of unreadable answers
    for level in sorted(tried.groupBy("_failed").count().collect()):
        if left <= level["count"]:
            own = first_rows(tried.filter(F.col("_failed") == level["_failed"]), "row_id", "row_id", left)
            return (F.col("_failed") < level["_failed"]) | ((F.col("_failed") == level["_failed"]) & own)
        left -= level["count"]
    return F.lit(True)


def build_prompts(records: DataFrame, template: str = PROMPT) -> DataFrame:
    """Fill ``{name}`` and ``{content}`` of the template."""
    before, rest = template.split("{name}", 1)
    between, after = rest.split("{content}", 1)
    return records.select("row_id", F.concat(
        F.lit(before), F.coalesce("Restaurant", F.lit("")), F.lit(between),
        F.coalesce("content", F.lit("")), F.lit(after)).alias("prompt"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """``row_id, answer`` -> derived fields and ``parsed``; a missing key gives an empty field."""
    bare = gsub(strip(F.col("answer")), rf"^```json{SPACE}*|{SPACE}*```\z", "")
    loaded = answers.select("row_id", "answer", F.try_parse_json(bare).alias("v"))
    # only an object has the two keys
    is_object = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    return loaded.select("row_id", "answer", is_object.alias("parsed"), *[
        F.when(is_object, F.coalesce(F.try_variant_get("v", f"$.{key}", "string"), F.lit("")))
        .alias(c) for c, key in DERIVED.items()])


def rejected_answers(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("parsed")).select("row_id", "answer")


def merge_answers(records: DataFrame, parsed: DataFrame) -> DataFrame:
    """Write parsed fields to their rows; all other rows stay as they are."""
    new = parsed.filter("parsed").select("row_id", F.struct(*DERIVED).alias("_new"))
    joined = records.join(new, "row_id", "left")
    return joined.withColumns({
        c: F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c))
        for c in DERIVED}).select(*records.columns)
