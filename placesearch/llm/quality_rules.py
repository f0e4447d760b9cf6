"""Quality rules: a table of thresholds compiled into one projection.

Every rule bounds one measure of a text: its length, its symbols, its stop words or its lines.  The
measures and the rules are Column expressions over the text alone, so a table of documents is judged
in one narrow pass without user functions and without a shuffle, whatever its size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm.landing import SPACE, table, text_of, whole_rows

# Fixed values.
SYMBOLS = "#*$%&|<>"
FEWEST_WORDS = 50
MOST_REPEATED = 50                # percent of the words
FEW_FOUND = 40                    # repeated windows up to which a text is searched for each of them
STOP_WORDS = tuple("""
a an and are as at be by for from have he her his i in is it not of on or that the they this to was were with you
als auf aus bei das dem den der des die du ein eine einen er es für ich im ist mit nicht sich sie und von zu
au ce dans de des du elle en est et il je la le les ne nous par pas pour que qui se sur un une vous
al como con del el ella ellos ese esta este la las lo los más mi no nos para pero por que se sin su un una y
""".split())


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie from ``low`` to ``high``; None is no bound."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", 50, 100_000),
    Rule("word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("letters", "letter_word_ratio", 0.7, None),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.3),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("cut_lines", "ellipsis_line_ratio", None, 0.3),
)


def _each(value: Column, function) -> Column:
    """``function`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more; windows are told apart by 64-bit hashes.

    Sorted hashes show which occur again.  Where these are few, the windows that have one of them
    are looked for in place; else windows are sorted with their places.  Both give the same places.
    Each place covers three words, less what the next one covers.
    """
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                         lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def again(row: Column) -> Column:
        hashes, order = row["hashes"], F.sort_array(row["hashes"])
        found = _each(order, lambda x: F.array_distinct(F.filter(x, lambda h, i: h == F.get(x, i - 1))))
        return F.struct(hashes.alias("hashes"), found.alias("found"))

    def sorted_places(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return _each(rows, lambda x: F.sort_array(F.transform(F.filter(
            x, lambda w, i: (w["h"] == F.get(x, i - 1)["h"]) | (w["h"] == F.get(x, i + 1)["h"])), lambda w: w["at"])))

    def places(row: Column) -> Column:
        hashes, found = row["hashes"], row["found"]
        return F.when(F.size(found) <= FEW_FOUND, F.filter(
            F.transform(hashes, lambda h, i: F.when(F.array_contains(found, h), i)), lambda i: i.isNotNull())
        ).otherwise(sorted_places(hashes))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
                           F.lit(0).cast("long"), lambda total, n: total + n)

    return _each(_each(F.struct(hashes.alias("hashes")), again), lambda row: F.when(
        F.size(row["found"]) == 0, F.lit(0).cast("long")).otherwise(_each(places(row), covered)))


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """``row`` (all columns as a struct) and one column per measure."""
    text = whole_rows(docs, text=text_of())
    parts = text.select("row", "text", F.array_remove(F.split("text", SPACE), "").alias("words"),
                        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    words, lines = F.col("words"), F.col("lines")
    counted = parts.select(
        "row", F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]++", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _count(words, lambda w: F.lower(w).isin(*STOP_WORDS)).alias("n_stop_words"),
        _count(words, lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
        _count(lines, lambda line: line.rlike(r"^[\x20\x09]*+[-*•]")).alias("n_bullets"),
        _count(lines, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$")).alias("n_cut_lines"))
    share = lambda n, of: F.col(n) / F.greatest(F.col(of), F.lit(1))
    return counted.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbol_ratio"),
        share("n_letter_words", "n_words").alias("letter_word_ratio"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_bullets", "n_lines").alias("bullet_line_ratio"),
        share("n_cut_lines", "n_lines").alias("ellipsis_line_ratio"))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of measures breaks, in the order of the table."""
    def broken(rule: Rule) -> Column:
        below = F.lit(False) if rule.low is None else F.col(rule.measure) < rule.low
        above = F.lit(False) if rule.high is None else F.col(rule.measure) > rule.high
        return F.when(below | above, F.lit(rule.name))

    return F.array_compact(F.array(*[broken(rule) for rule in rules]).cast("array<string>"))


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows of three words."""
    return ((F.col("n_words") < FEWEST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: ``row``, the measures, ``base_failed``, ``broken`` and ``kept``.

    ``row`` holds the document's own columns, so names cannot clash.  A null text counts as empty:
    no words, all ratios 0, not kept.  Rows that repeat are judged each; a null id stays null.  The
    text is read whole; a text's words and windows must fit in its task.
    """
    told = measured(docs).withColumn("base_failed", base_failed()).withColumn("broken", compile_rules(rules))
    return told.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with all their columns."""
    return judge(docs, rules).filter("kept").select("row.*")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


QUERIES = {"op11_quality_rules": op11_quality_rules}


def _sql() -> str:
    space = r"[\x20\x09-\x0D]+"
    has_word = r"regexp_matches(x, '[^\x20\x09-\x0D]')"
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    failing = ", ".join("CASE WHEN " + " OR ".join(
        [f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None))
        + f" THEN '{r.name}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT id, doc_id, t, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: {has_word}) AS l FROM d),
u AS (SELECT id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM p),
g AS (SELECT id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS e FROM u WINDOW o AS (PARTITION BY id ORDER BY i)),
k AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, e) AS n FROM g WHERE e IS NOT NULL),
c AS (SELECT id, count(DISTINCT j)::BIGINT AS n_repeat_words
      FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter,
             len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*\x{{2022}}]'))) AS n_bullets,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[ \t\r]*$'))) AS n_cut
      FROM p LEFT JOIN c USING (id)),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
             n_letter / greatest(n_words, 1) AS letter_word_ratio, n_stop / greatest(n_words, 1) AS stop_word_ratio,
             n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_bullets / greatest(n_lines, 1) AS bullet_line_ratio,
             n_cut / greatest(n_lines, 1) AS ellipsis_line_ratio FROM m),
b AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
             list_filter([{failing}], lambda x: x IS NOT NULL) AS broken FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(broken) = 0 AS kept, coalesce(array_to_string(broken, ','), '') AS broken FROM b"""


SQL = {"op11_quality_rules": _sql()}
