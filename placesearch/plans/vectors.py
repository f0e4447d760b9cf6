"""Registered queries: search documents and vector search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from placesearch.functions.lexicon import STATE_NAMES
from placesearch.operators import searchdocs, vectorindex, vectors
from placesearch.plans.inputs import SQL_DIRECTORY, directory, table
from placesearch.session import shared_folder


def documents(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding",
                                                "label")


def every_query(spark, d):
    """Every vector as a query of its own."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"),
                                                F.col("embedding").alias("vector"))


def centre(spark, d) -> list[float]:
    """The mean of all vectors: one query that depends on the whole table."""
    cells = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return [r.m for r in means.orderBy("i").collect()]


def _rounded(found):
    return found.withColumn("distance", F.round("distance", 6))


def _docs(spark, d):
    return searchdocs.build_documents(directory(spark, d))


def _metadata(spark, d):
    """The metadata object of each document, read back field by field."""
    found = searchdocs.metadata_columns(_docs(spark, d))
    return found.select("page_content", *[
        F.get_json_object("metadata", f"$.{name}").alias(alias)
        for name, alias in (("ID", "ID"), ("State Name", "state_name"), ("Honor Roll", "honor_roll"),
                            ("sig_item", "sig_item"), ("content", "content"))])


def _report(spark, d):
    docs = _docs(spark, d).select(F.col("ID").alias("doc_id"), "page_content", "Restaurant", "City")
    n = table(spark, d, "supplier").count()
    # vectors of places that are crossed out are left out before the nearest are chosen
    place = documents(spark, d).withColumn("place", F.col("doc_id") % n)
    there = place.join(docs.select(F.col("doc_id").alias("place")), "place", "left_semi")
    found = vectors.knn_batch(there.drop("place"), every_query(spark, d), 3)
    return searchdocs.hit_report(found.withColumn("doc_id", F.col("doc_id") % n)
                                 .join(docs, "doc_id"))


def _approx(spark, d):
    """Recall of a search in the stored index against the exact one, and whether it reaches its floor."""
    folder = f"{shared_folder(spark)}/placesearch-index-{uuid.uuid4().hex}"
    vectorindex.build(documents(spark, d), folder)
    found = vectors.recall(vectors.knn_batch(documents(spark, d), every_query(spark, d), 4),
                           vectorindex.knn_approx(documents(spark, d), every_query(spark, d), folder, 4))
    return found.select("expected", (F.col("recall") >= vectors.RECALL_FLOOR).alias("reached"),
                        (F.col("found") <= F.col("expected")).alias("sound"))


QUERIES = {
    "read_records_pruned": lambda spark, d: searchdocs.read_pruned(directory(spark, d)),
    "drop_crossed_out": lambda spark, d: searchdocs.drop_crossed_out(directory(spark, d)),
    "state_name": lambda spark, d: directory(spark, d).select(
        "ID", searchdocs.state_name(F.col("State")).alias("state_name"),
        searchdocs.state_name(F.substring("geohash", 1, 2)).alias("unknown_name")),
    "compose_document": lambda spark, d: _docs(spark, d).select("ID", "page_content"),
    "metadata_columns": _metadata,
    "knn": lambda spark, d: _rounded(vectors.knn(documents(spark, d), centre(spark, d), 10)),
    "knn_filtered": lambda spark, d: _rounded(vectors.knn(
        documents(spark, d), centre(spark, d), 10, F.col("label").isin(1, 3))),
    "knn_batch": lambda spark, d: _rounded(vectors.knn_batch(
        documents(spark, d), every_query(spark, d), 4)),
    "knn_batch_blocks": lambda spark, d: _rounded(vectors.knn_batch(
        documents(spark, d), every_query(spark, d), 4, broadcast_numbers=0)),
    "knn_approx": _approx,
    "example_search_report": _report,
}

_NAMES = ", ".join(f"('{c}', '{n}')" for c, n in STATE_NAMES.items())
_DOCS = f"""{SQL_DIRECTORY}, names(code, name) AS (VALUES {_NAMES}),
docs AS (
  SELECT d.*, name AS "State Name", 'Restaurant: ' || "Restaurant" || chr(10) || 'Location: ' || "City"
    || ', ' || coalesce(name, 'Unknown State') || chr(10) || 'Signature Item: '
    || coalesce(sig_item, 'Unknown Item') || chr(10) || chr(10) || content AS page_content
  FROM directory d LEFT JOIN names ON code = "State" WHERE "Crossout" IS DISTINCT FROM 'y')
"""
_CENTRE = """
cells AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
centre AS (SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(x) AS m FROM cells GROUP BY i))
"""
_NEAR = """row_number() OVER (ORDER BY list_distance(embedding::DOUBLE[], v), vec_id)::INT AS rank,
  vec_id AS doc_id, round(list_distance(embedding::DOUBLE[], v) ** 2, 6) AS distance, label"""


def _pairs(k: int, among: str = "embeddings") -> str:
    return f"""pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id,
        list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist
        FROM embeddings q CROSS JOIN {among} e),
      near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, doc_id)::INT AS rank
        FROM pairs QUALIFY rank <= {k})"""


_BATCH = f"""WITH {_pairs(4)} SELECT query_id, rank, doc_id, round(dist ** 2, 6) AS distance FROM near"""
_READ = ", ".join(f'"{c}"' for c in searchdocs.READ_COLUMNS)

SQL = {
    "read_records_pruned": f"WITH {SQL_DIRECTORY} SELECT {_READ} FROM directory",
    "drop_crossed_out": f"""WITH {SQL_DIRECTORY} SELECT * EXCLUDE "Crossout" FROM directory
      WHERE "Crossout" IS DISTINCT FROM 'y'""",
    "state_name": f"""WITH {SQL_DIRECTORY}, names(code, name) AS (VALUES {_NAMES})
      SELECT "ID", name AS state_name, NULL::VARCHAR AS unknown_name
      FROM directory LEFT JOIN names ON code = "State" """,
    "compose_document": f'WITH {_DOCS} SELECT "ID", page_content FROM docs',
    "metadata_columns": f"""WITH {_DOCS} SELECT page_content, "ID"::VARCHAR AS "ID",
      "State Name" AS state_name, "Honor Roll" AS honor_roll, sig_item, NULL::VARCHAR AS content FROM docs""",
    "knn": f"WITH {_CENTRE} SELECT {_NEAR} FROM embeddings, centre QUALIFY rank <= 10",
    "knn_filtered": f"""WITH {_CENTRE} SELECT {_NEAR} FROM embeddings, centre
      WHERE label IN (1, 3) QUALIFY rank <= 10""",
    "knn_batch": _BATCH,
    "knn_batch_blocks": _BATCH,
    "knn_approx": """SELECT count(*) * least(4, count(*)) AS expected, true AS reached, true AS sound
      FROM embeddings""",
    "example_search_report": f"""WITH {_DOCS}, there AS (FROM embeddings WHERE vec_id % (SELECT count(*)
        FROM supplier) IN (SELECT "ID" FROM docs)), {_pairs(3, 'there')}
      SELECT query_id, rank, 'Restaurant: ' || "Restaurant" AS first_line,
        "Restaurant" || ' in ' || "City" AS place
      FROM near JOIN docs ON "ID" = doc_id % (SELECT count(*) FROM supplier)""",
}
