"""What the log tables must look like, and reports on how far they do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Allowed codes, needed columns and defaults of the log tables.
ALLOWED = {
    "search_results": {"search_type": ("detailed", "summary"), "feedback_success": ("y", "n")},
    "result_scores": {"honor_roll": ("y", "n"), "recommend": ("y", "n"), "relevant": ("y", "n")},
}
REQUIRED = {
    "search_results": ("id", "search_id", "query", "timestamp", "created_at"),
    "result_scores": ("id", "search_id", "restaurant_id", "restaurant_name", "similarity_score",
                      "rank", "created_at"),
}
UNIQUE = {"search_results": ("id", "search_id"), "result_scores": ("id",)}
DEFAULTS = {
    "search_results": {"id": "generated", "timestamp": "now", "created_at": "now"},
    "result_scores": {"id": "generated", "created_at": "now", "honor_roll": "n",
                      "recommend": "n"},
}
KIND_RANK = {"column": 1, "constraint": 2, "view": 4, "materialized view": 5}


def _row_rules(table: str) -> dict[tuple[str, str], Column]:
    """(type, rule) -> condition that marks a bad row; a null never breaks a value rule."""
    rules = {("NOT NULL", c): F.col(c).isNull() for c in REQUIRED[table]}
    for column, codes in ALLOWED[table].items():
        rules[("CHECK", f"{column} in ({', '.join(codes)})")] = ~F.col(column).isin(*codes)
    if table == "result_scores":
        rules[("CHECK", "similarity_score >= 0")] = F.col("similarity_score") < 0
        rules[("CHECK", "rank > 0")] = F.col("rank") <= 0
    return rules


def _row_violations(rows: DataFrame, table: str) -> DataFrame:
    """All row rules of a table in one pass."""
    rules = _row_rules(table)
    counted = rows.agg(*[F.count_if(bad).alias(f"r{i}") for i, bad in enumerate(rules.values())])
    report = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(rule).alias("rule"),
                                F.col(f"r{i}").alias("violations"))
                       for i, (kind, rule) in enumerate(rules)])
    return counted.select(F.inline(report)).select(F.lit(table).alias("table"), "*")


def _repeats(rows: DataFrame, table: str, column: str) -> DataFrame:
    repeated = (rows.filter(F.col(column).isNotNull()).groupBy(column)
                .agg(F.count("*").alias("n")).filter("n > 1"))
    return repeated.agg(F.count("*").alias("violations")).select(
        F.lit(table).alias("table"), F.lit("UNIQUE").alias("type"), F.lit(column).alias("rule"),
        "violations")


def check_constraints(searches: DataFrame, scores: DataFrame) -> DataFrame:
    """``table, type, rule, violations`` for every declared rule."""
    tables = {"search_results": searches, "result_scores": scores}
    parts = [_row_violations(rows, name) for name, rows in tables.items()]
    parts += [_repeats(tables[name], name, column)
              for name, columns in UNIQUE.items() for column in columns]
    orphans = (scores.select("search_id").filter(F.col("search_id").isNotNull())
               .join(searches.select("search_id"), "search_id", "left_anti"))
    parts.append(orphans.agg(F.count("*").alias("violations")).select(
        F.lit("result_scores").alias("table"), F.lit("FOREIGN KEY").alias("type"),
        F.lit("search_id").alias("rule"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def _columns(rows: DataFrame, table: str) -> DataFrame:
    listed = [(table, "column", f.name,
               f.dataType.simpleString()
               + (" NOT NULL" if f.name in REQUIRED[table] else "")
               + (f" DEFAULT {DEFAULTS[table][f.name]}" if f.name in DEFAULTS[table] else ""))
              for f in rows.schema.fields]
    return rows.sparkSession.createDataFrame(
        listed, "table_name string, object_type string, object_name string, definition string")


def contract_report(searches: DataFrame, scores: DataFrame, view: DataFrame,
                    rollup: DataFrame) -> DataFrame:
    """Columns, constraints and views of the log in one listing."""
    rules = check_constraints(searches, scores).select(
        F.col("table").alias("table_name"), F.lit("constraint").alias("object_type"),
        F.concat("type", F.lit(" "), "rule").alias("object_name"),
        F.concat(F.when(F.col("violations") == 0, "holds").otherwise("broken"), F.lit(": "),
                 F.col("violations")).alias("definition"))
    views = view.agg(F.count("*").alias("n")).select(
        F.lit("searches_with_scores").alias("table_name"), F.lit("view").alias("object_type"),
        F.lit("searches_with_scores").alias("object_name"),
        F.concat(F.lit(f"{len(view.columns)} columns, rows: "), F.col("n")).alias("definition"))
    stored = rollup.agg(F.count("*").alias("n")).select(
        F.lit("daily_analytics").alias("table_name"),
        F.lit("materialized view").alias("object_type"),
        F.lit("daily_analytics").alias("object_name"),
        F.concat(F.lit("Is populated: "), F.col("n") > 0).alias("definition"))
    parts = [_columns(searches, "search_results"), _columns(scores, "result_scores"), rules,
             views, stored]
    rank = reduce(lambda c, kv: c.when(F.col("object_type") == kv[0], kv[1]),
                  KIND_RANK.items(), F.when(F.lit(False), 0))
    return reduce(DataFrame.unionByName, parts).orderBy("table_name", rank, "object_name")


def required_columns(tables: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """For each needed column: is it there, and how many rows fill it?"""
    parts = []
    for name, (rows, columns) in tables.items():
        present = {c: c in rows.columns for c in columns}
        counted = rows.agg(*[(F.count(F.col(c)) if here else F.lit(0).cast("long")).alias(c)
                             for c, here in present.items()])
        parts.append(counted.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                     F.lit(here).alias("present"), F.col(c).alias("filled"))
            for c, here in present.items()]))))
    return reduce(DataFrame.unionByName, parts)
