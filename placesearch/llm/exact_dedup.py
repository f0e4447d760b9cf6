"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size.  Equal blocks get one integer name, different blocks get
different names; then adjacent names are paired and the pairs are named in the same way, until each
text has one name.  Texts with as many blocks and the same last name are equal: names stand for
contents, so no hash has to be trusted.

Block texts are shuffled once, after each task has merged its equal blocks, so a group of copies
arrives as one row per task.  Hashes only bring blocks together; blocks that share a hash are
ranked by their contents.  Everything after the first level is integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm.landing import SPACE, dealt_anew, land, table, text_of, whole_rows

BLOCK = 2048          # characters
_ALONE = -1           # the partner of a last name without one
_UNIT = ["_doc", "_sha"]


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), SPACE, " ")


def _block_hash(column: str, bits: int) -> Column:
    """Brings equal blocks together; ``bits`` is lowered in tests to make blocks collide."""
    return F.shiftrightunsigned(F.xxhash64(column), 64 - bits) if bits < 64 else F.xxhash64(column)


def _named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Different rows of ``columns`` with an integer ``name``, in sorted order within a task.

    The table is written, so every later reader sees the same names.
    """
    ordered = keys.sortWithinPartitions(*columns)
    return land(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _block_names(blocks: DataFrame) -> DataFrame:
    """Name of each different block: ``_h, _rank, name`` and, where a hash is shared, ``_block``."""
    sets = blocks.groupBy("_h").agg(F.sort_array(F.collect_set("_block")).alias("_set"))
    ranked = sets.select("_h", (F.size("_set") > 1).alias("_shared"), F.posexplode("_set")
                         .alias("_rank", "_block"))
    return _named(ranked.select("_h", "_rank", F.when(F.col("_shared"), F.col("_block"))
                                .alias("_block")), ["_h", "_rank"])


def identities(units: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """``units``: a key ``_doc, _sha`` and ``_text``; gives the key with ``blocks`` and ``name``."""
    parts = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cut = F.when(F.col("_text") == "", F.array(F.lit(""))).otherwise(parts)
    cells = (units.select(*_UNIT, F.posexplode(cut).alias("_pos", "_block"))
             .withColumn("_h", _block_hash("_block", bits)))
    names = _block_names(cells.select("_h", "_block"))
    plain = names.filter("_block IS NULL").select("_h", "name")
    level = cells.select(*_UNIT, "_pos", "_h").join(plain, "_h").select(*_UNIT, "_pos", "name")
    shared = names.filter("_block IS NOT NULL")
    if not shared.isEmpty():
        # blocks whose hash is shared by a different block are told apart by their text
        level = level.unionByName(cells.join(shared.select("_h", "_block", "name"), ["_h", "_block"])
                                  .select(*_UNIT, "_pos", "name"))
    level = land(level, "blocks")
    sizes = level.groupBy(*_UNIT).agg((F.max("_pos") + 1).alias("blocks"))
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    done = []
    level = level.join(sizes, _UNIT)
    width = 1
    while True:
        done.append(level.filter(F.col("blocks") <= width).select(*_UNIT, "blocks", "name"))
        if width >= most:
            break
        level = land(_next_level(level.filter(F.col("blocks") > width)), "level")
        width *= 2
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found


def _next_level(level: DataFrame) -> DataFrame:
    """Name adjacent pairs of names."""
    side = F.col("_pos") % 2
    pairs = level.groupBy(*_UNIT, "blocks", F.expr("_pos div 2").cast("int").alias("_pos")).agg(
        F.max(F.when(side == 0, F.col("name"))).alias("_left"),
        F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(_ALONE)).alias("_right"))
    names = _named(pairs.select("_left", "_right").distinct(), ["_left", "_right"])
    return (pairs.join(names, ["_left", "_right"])
            .select(*_UNIT, "_pos", "name", "blocks"))


def exact_duplicates(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are the same after each run of blanks became one space; null counts
    as empty.  The smallest ``doc_id`` of a group stays.  Rows that repeat a ``doc_id`` and its text
    are counted each, and one of them stays.  A row without ``doc_id`` stays only when no row of its
    group has one (``keep_id`` is then null).  Other columns are not read.
    """
    texts = docs.select(F.col("doc_id").alias("_doc"), normalised().alias("_text"))
    texts = texts.withColumn("_sha", F.sha2("_text", 256))
    rows = texts.select("_doc", "_sha")
    # a missing id must still meet itself in joins
    named = identities(texts.withColumn("_doc", _key("_doc")), block, bits).distinct()
    units = land(rows.groupBy(_key("_doc").alias("_doc"), "_sha")
                 .agg(F.count("*").alias("copies"), F.first("_doc").alias("doc_id"))
                 .join(named, _UNIT), "units")
    groups = dealt_anew(units.groupBy("blocks", "name").agg(
        F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")))
    judged = units.join(groups, ["blocks", "name"])
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")
    return (judged.select("doc_id", "keep_id", "group_size", F.col("_sha").alias("text_sha256"), copy)
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1))
                    .alias("kept"), "text_sha256"))


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_duplicates(docs).filter("kept").select(_key("doc_id").alias("key"),
                                                        F.col("text_sha256").alias("sha"))
    keyed = whole_rows(docs, key=_key("doc_id"), sha=F.sha2(normalised(), 256))
    # rows that repeat an id and its text: one stays
    return keyed.join(kept, ["key", "sha"], "left_semi").dropDuplicates(["key", "sha"]).select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}

SQL = {"op2_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n
           FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g USING (n)"""}
