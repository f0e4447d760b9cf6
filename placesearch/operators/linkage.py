"""Guidebook records linked to a geocoded directory: one exact and two fuzzy passes.

``guide``: ``row_id, title, State`` and the other record fields; ``row_id`` names a source row.
``directory``: ``row_no, ID, Restaurant, State, ...``; ``row_no`` is the sheet's row order.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from placesearch.functions.names import extract_state, merge_key, token_sort
from placesearch.operators.similar import (
    BLOCK_NAMES, best_in_blocks, best_of_all, near_pairs, pairs_within,
)
from placesearch.session import cut_lineage

# Thresholds, column order and flags of the linked table.
HIGH, LOW = 85.0, 25.0
DIRECTORY_COLUMNS = ("ID", "City", "Address", "Region", "Crossout", "Honor Roll", "Recommend",
                     "long", "lat", "geohash")
LINKED_ORDER = ("ID", "title", "Restaurant", "URL", "address_full", "Address", "City", "State",
                "Region", "phone", "hours", "cost", "content", "Crossout", "Honor Roll",
                "Recommend", "long", "lat", "geohash")
PROFILED = ("City", "Address", "Region", "Crossout", "Honor Roll", "Recommend", "long", "lat",
            "geohash")
EDITION = "10th Ed."
PAIRS = 20_000_000        # names and candidates of one state that are compared without a join before


def _col(name: str):
    return F.col(f"`{name}`")


def rename_on_read(records: DataFrame) -> DataFrame:
    return records.withColumnRenamed("address", "address_full")


def with_state(records: DataFrame) -> DataFrame:
    return records.withColumn("State", extract_state(F.col("address_full")))


def state_coverage(records: DataFrame) -> DataFrame:
    return records.agg(F.count("State").alias("with_state"), F.count("*").alias("total"))


def missing_columns(guide: DataFrame, directory: DataFrame) -> list[str]:
    need = [(guide, "guide", "title"), (guide, "guide", "State"),
            (directory, "directory", "Restaurant"), (directory, "directory", "State")]
    return [f"{where}.{column}" for df, where, column in need if column not in df.columns]


def link_columns(linked: DataFrame) -> DataFrame:
    """The fixed column order, any other columns behind."""
    first = [c for c in LINKED_ORDER if c in linked.columns]
    return linked.select(*map(_col, first), *[_col(c) for c in linked.columns
                                              if c not in LINKED_ORDER])


def exact_link(guide: DataFrame, directory: DataFrame, how: str = "left") -> DataFrame:
    """Left join on name and state; repeated directory names fan out.

    A missing state matches a missing state; a missing name matches nothing, as all rows without a name
    would else meet on one key.
    """
    missing = missing_columns(guide, directory)
    if missing:
        raise ValueError("columns needed for linking are missing: " + ", ".join(missing))
    left = guide.withColumn("_key", merge_key(F.col("title")))
    right = directory.select(merge_key(F.col("Restaurant")).alias("_name"),
                             F.col("State").alias("_state"), "Restaurant",
                             *map(_col, DIRECTORY_COLUMNS))
    joined = left.join(right, (F.col("_key") == F.col("_name"))
                       & F.col("State").eqNullSafe(F.col("_state")), how)
    return link_columns(joined.drop("_key", "_name", "_state"))


@dataclass
class ExactLink:
    """What the exact pass gives, in parts: a name that repeats on both sides fans out in ``matched`` only."""

    matched: DataFrame        # rows of ``exact_link`` with an ID
    open: DataFrame           # rows of ``exact_link`` without one
    used: DataFrame           # the IDs in ``matched``, once each

    @property
    def linked(self) -> DataFrame:
        return self.matched.unionByName(self.open)


def exact_parts(guide: DataFrame, directory: DataFrame) -> ExactLink:
    """``exact_link`` in parts; open rows and used IDs come from keys, not from the pairs of equal names."""
    has_id = F.col("ID").isNotNull()
    keys = directory.select(merge_key(F.col("Restaurant")).alias("_name"), F.col("State").alias("_state")).distinct()
    equal = (F.col("_key") == F.col("_name")) & F.col("State").eqNullSafe(F.col("_state"))
    keyed = guide.withColumn("_key", merge_key(F.col("title")))
    # met by no name, or by a directory row without an ID
    open_rows = (exact_link(keyed.join(keys, equal, "left_anti").drop("_key"), directory.limit(0))
                 .unionByName(exact_link(keyed.join(keys, equal, "left_semi").drop("_key"), directory.filter(~has_id), "inner")))
    named = guide.select(merge_key(F.col("title")).alias("_key"), F.col("State").alias("_of")).distinct()
    used = (directory.filter(has_id).withColumn("_name", merge_key(F.col("Restaurant")))
            .join(named, (F.col("_key") == F.col("_name")) & F.col("State").eqNullSafe(F.col("_of")), "left_semi"))
    return ExactLink(exact_link(guide, directory.filter(has_id), "inner"), open_rows, used.select("ID").distinct())


def completeness(linked: DataFrame) -> DataFrame:
    """Filled rows and percentage of the profiled columns."""
    counts = linked.agg(F.count("*").alias("_n"), *[F.count(_col(c)).alias(c) for c in PROFILED])
    return counts.select("_n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _col(c).alias("filled")) for c in PROFILED]))
    ).select("column_name", "filled",
             F.when(F.col("_n") > 0, F.col("filled") / F.col("_n") * 100).alias("percent"))


def unmatched_rows(linked: DataFrame) -> DataFrame:
    return linked.filter(F.col("ID").isNull())


def unused_directory(directory: DataFrame, linked: DataFrame) -> DataFrame:
    """Directory rows that no linked row uses."""
    used = linked.select("ID").filter(F.col("ID").isNotNull()).distinct()
    return directory.join(used, "ID", "left_anti")


def edition_filter(directory: DataFrame) -> DataFrame:
    """Rows of the edition, where the sheet says so."""
    return directory.filter(_col(EDITION) == "y") if EDITION in directory.columns else directory


def blocked_candidates(directory: DataFrame) -> DataFrame:
    """One candidate per state and lowercase name: the last row, at the first row's position."""
    named = directory.filter(F.col("State").isNotNull() & F.col("Restaurant").isNotNull())
    fields = F.struct("Restaurant", *map(_col, DIRECTORY_COLUMNS))
    return (named.groupBy("State", F.lower("Restaurant").alias("name"))
            .agg(F.min("row_no").alias("position"),
                 F.max_by(fields, F.col("row_no")).alias("candidate")))


def name_scores(names: DataFrame, candidates: DataFrame, high: float = HIGH,
                block_rows: int = BLOCK_NAMES) -> DataFrame:
    """Best candidate per distinct ``(State, left_key)``: ``position, score``.

    Names equal up to word order score 100 and are settled by a plain join, and those with a
    candidate at ``high`` by a similarity join.  Only the others are compared within their state,
    block by block.  While a state's names and candidates are few pairs, all are compared at once.
    """
    rights = (candidates.select("State", token_sort(F.col("name")).alias("right_key"), "position")
              .groupBy("State", "right_key").agg(F.min("position").alias("position")))
    # both are short tables of distinct names, read several times below
    rights, names = cut_lineage(rights), cut_lineage(names)
    same = names.join(rights.withColumnRenamed("right_key", "left_key"), ["State", "left_key"])
    other = names.join(rights.select("State", F.col("right_key").alias("left_key")),
                       ["State", "left_key"], "left_anti")
    if pairs_within(names, rights) <= PAIRS:
        best = best_of_all(other, rights)
    else:
        near = cut_lineage(near_pairs(other, rights, high))
        far = other.join(near, ["State", "left_key"], "left_anti")
        best = near.unionByName(best_in_blocks(far, rights, block_rows))
    return best.unionByName(same.withColumn("score", F.lit(100.0)))


def best_match(unmatched: DataFrame, directory: DataFrame, high: float = HIGH,
               block_rows: int = BLOCK_NAMES) -> DataFrame:
    """Highest-scoring candidate of its state for each row: ``row_id, score, candidate``.

    Rows without a state or a candidate give no row.
    """
    rows = unmatched.select("row_id", "State", token_sort(F.lower("title")).alias("left_key")
                            ).filter(F.col("State").isNotNull() & F.col("left_key").isNotNull())
    candidates = blocked_candidates(directory)
    best = name_scores(rows.select("State", "left_key").distinct(), candidates, high, block_rows)
    chosen = best.join(candidates.select("State", "position", "candidate"), ["State", "position"])
    return rows.join(chosen, ["State", "left_key"]).select(
        "row_id", "State", "score", "candidate")


def accept(best: DataFrame, threshold: float) -> DataFrame:
    return best.filter(F.col("score") >= threshold)


def patch_linked(linked: DataFrame, accepted: DataFrame) -> DataFrame:
    """Copy the accepted candidate's fields, nulls too, onto its unmatched row."""
    new = accepted.select("row_id", F.col("candidate").alias("_c"))
    joined = linked.join(new, "row_id", "left")
    take = F.col("_c").isNotNull() & F.col("ID").isNull()
    patched = {c: F.when(take, F.col("_c").getField(c)).otherwise(_col(c))
               for c in ("Restaurant", *DIRECTORY_COLUMNS)}
    return joined.select(*[patched[c].alias(c) if c in patched else _col(c)
                           for c in linked.columns])


def fuzzy_pass(linked: DataFrame, directory: DataFrame, threshold: float) -> DataFrame:
    """One fuzzy pass over what is unmatched and unused: ``row_id, State, score, candidate``."""
    unused = edition_filter(unused_directory(directory, linked))
    return accept(best_match(unmatched_rows(linked), unused), threshold)


@dataclass
class Linkage:
    """Everything the three passes give."""

    exact: DataFrame          # after the exact pass
    best_high: DataFrame      # best candidates seen by the high pass, accepted or not
    high: DataFrame           # accepted at 85
    low: DataFrame            # accepted at 25 from what was left
    final: DataFrame          # all passes applied
    patched: DataFrame        # the rows of ``final`` that the exact pass left open
    used: DataFrame           # the IDs in ``final``


def link(guide: DataFrame, directory: DataFrame, high: float = HIGH,
         low: float = LOW) -> Linkage:
    """All three passes; each table of matches is written out before the next pass reads it.

    Only ``final`` and ``exact`` hold the pairs of equal names; the passes work on what is open.
    """
    parts = exact_parts(guide, directory)
    unmatched = cut_lineage(parts.open.select("row_id", "title", "State"))
    unused = cut_lineage(edition_filter(unused_directory(directory, parts.used)))
    best_high = cut_lineage(best_match(unmatched, unused))
    accepted_high = accept(best_high, high)
    taken = accepted_high.select(F.col("candidate.ID").alias("ID")).distinct()
    best_low = cut_lineage(best_match(
        unmatched.join(accepted_high.select("row_id"), "row_id", "left_anti"),
        unused.join(taken, "ID", "left_anti")))
    accepted_low = accept(best_low, low)
    patched = patch_linked(parts.open, accepted_high.unionByName(accepted_low))
    used = parts.used.unionByName(patched.select("ID").filter(F.col("ID").isNotNull()))
    return Linkage(parts.linked, best_high, accepted_high, accepted_low, parts.matched.unionByName(patched), patched, used)


def unmatched_report(done: Linkage) -> DataFrame:
    """Rows no pass matched, with the best candidate the high pass saw for them in front."""
    c = F.col("candidate")
    seen = done.best_high.select(
        "row_id", F.col("score").alias("Match_Score"), c["Restaurant"].alias("Best_Match"),
        F.col("State").alias("Excel_State"), c["ID"].alias("Excel_ID"))
    left = unmatched_rows(done.patched)
    return left.join(seen, "row_id", "left").select(
        "Match_Score", "Best_Match", "Excel_State", "Excel_ID", *map(_col, left.columns))


def unused_report(directory: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows of the edition that were never used."""
    return edition_filter(unused_directory(directory, linked))


def pass_summary(guide: DataFrame, done: Linkage) -> DataFrame:
    """Matches of each pass, the match rate so far and the rows still unmatched."""
    steps = [("all", guide.agg(F.count("*").alias("matches"), F.lit(0).alias("open"))),
             ("exact", done.exact.agg(F.count("Restaurant").alias("matches"),
                                      F.count_if(F.col("ID").isNull()).alias("open")))]
    steps += [(name, p.agg(F.count("*").alias("matches"), (-F.count("*")).alias("open")))
              for name, p in (("high", done.high), ("low", done.low))]
    table = reduce(DataFrame.unionByName, [
        p.withColumns({"pass_no": F.lit(i), "pass": F.lit(name), "_all": F.lit(1)})
        for i, (name, p) in enumerate(steps)])                    # four rows
    whole = Window.partitionBy("_all")
    so_far = whole.orderBy("pass_no")
    total = F.max(F.when(F.col("pass_no") == 0, F.col("matches"))).over(whole)
    return table.select(
        "pass_no", "pass", "matches",
        ((F.sum("matches").over(so_far) - total) / total * 100).alias("match_rate"),
        F.sum("open").over(so_far).alias("remaining")).filter("pass_no > 0")
