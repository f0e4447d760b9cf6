"""Query tables -> filters -> restricted vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from placesearch.functions import geo
from placesearch.operators.blocks import BLOCK_ROWS, compare_in_blocks
from placesearch.operators.rows import explode_once
from placesearch.operators.vectors import (
    DEFAULT_K, _first_places, _nearest_in_parts, _ranked, _rows_of, check_k, knn_batch,
)
from placesearch.session import cut_lineage

TASK_TEXTS = 50_000       # queries of a task that looks for places
MOST_CITIES = 100_000     # names in a trie that is broadcast: about 30 MB
BROADCAST_NUMBERS = 16_000_000    # of documents that go to every task: 64 MB of floats


def scope_gate(queries: DataFrame) -> DataFrame:
    """Keep the queries whose stored ``answer`` says they are in scope."""
    return queries.filter(geo.in_scope(F.col("answer")))


_CITIES = "array<struct<City:string,states:array<string>>>"


def city_trie(cities: list[tuple[list[str], str, list[str]]]) -> dict:
    """``(words, City, states)`` as a trie over words; what ends at a node stands under the key None."""
    root: dict = {}
    for words, city, states in cities:
        node = root
        for word in words:
            node = node.setdefault(word, {})
        node.setdefault(None, []).append((city, states))
    return root


def cities_in(words: list[str], trie: dict) -> list[tuple[str, list[str]]]:
    """The cities whose words stand in a row in a text, each once, by walks from every word."""
    found: dict[str, list[str]] = {}
    for at in range(len(words)):
        node = trie
        for word in words[at:]:
            node = node.get(word)
            if node is None:
                break
            found.update(node.get(None, ()))
    return sorted(found.items())


def _states_by_city(directory: DataFrame) -> DataFrame:
    return (directory.select("City", "State").dropna().groupBy("City").agg(
        F.sort_array(F.collect_set("State")).alias("states"))       # at most one per state
        .withColumn("words", geo.words(F.col("City"))).filter(F.size("words") > 0))


def _with_candidates(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """``queries`` with ``found``: the directory cities whose names stand in the text.

    The names are counted; while they are few a trie of them goes to every task, so a text gives no
    rows but its cities.  Beyond that, word runs of the lengths that names have are joined to them.
    """
    cities = _states_by_city(directory)
    rows = cities.limit(MOST_CITIES + 1).collect()
    if len(rows) > MOST_CITIES:
        return _joined_candidates(queries, cut_lineage(cities))
    shared = queries.sparkSession.sparkContext.broadcast(city_trie([(r.words, r.City, r.states) for r in rows]))

    @F.pandas_udf(_CITIES)
    def found(texts: pd.Series) -> pd.Series:
        trie = shared.value
        return pd.Series([None if w is None else [{"City": c, "states": s} for c, s in cities_in(list(w), trie)]
                          for w in texts], dtype=object)

    return queries.withColumn("found", found(geo.words(F.col("text"))))


def _joined_candidates(queries: DataFrame, cities: DataFrame) -> DataFrame:
    # a few numbers, whatever the directory's size
    lengths = sorted(r.n for r in cities.select(F.size("words").alias("n")).distinct().collect())
    named = cities.select(F.array_join("words", " ").alias("phrase"), F.struct("City", "states").alias("c"))
    runs = explode_once(queries, ["query_id"], geo.phrases(F.col("text"), lengths), "phrase").drop("pos")
    found = runs.join(named, "phrase").groupBy("query_id").agg(F.sort_array(F.collect_set("c")).alias("found"))
    return queries.join(found, "query_id", "left")


def _cities(named: Column) -> Column:
    """``found`` as city and state: all states of a name, unless the text names some of them."""
    def placed(c: Column) -> Column:
        both = F.array_intersect(c["states"], named)
        return F.transform(F.when(F.size(both) > 0, both).otherwise(c["states"]), lambda s: F.struct(
            c["City"].alias("city"), s.alias("state")))

    return F.array_sort(F.flatten(F.transform("found", placed)))


def city_lookup(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """Directory cities a query names as whole words: ``query_id, City, State``; ids are unique.

    A name found in several states gives all of them, unless the query names some of them.
    """
    asked = _with_candidates(queries.select("query_id", "text"), directory).filter(F.size("found") > 0)
    named = asked.withColumn("named", geo.state_codes(F.col("text")))
    return named.select("query_id", F.inline(_cities(F.col("named")))).select(
        "query_id", F.col("city").alias("City"), F.col("state").alias("State"))


def _with_filters(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """``queries`` with what their texts name: ``states, regions, broad, cities``."""
    text = F.col("text")
    named = _with_candidates(queries, directory).withColumns({
        "states": geo.state_codes(text), "regions": geo.region_names(text), "broad": geo.broad_states(text)})
    return named.withColumn("cities", F.when(F.size("found") > 0, _cities(F.col("states")))).drop("found")


def query_filters(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """Each query with everything its text names and the combined filter as JSON."""
    texts = queries.select("query_id", "text")
    # joins give tasks by bytes, which are few beside the work on a text
    texts = texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, -(-texts.count() // TASK_TEXTS)))
    found = _with_filters(texts, directory).drop("text")
    conditions = geo.dedupe_conditions(F.array_compact(F.array(
        geo.in_condition("State", F.col("states")), geo.in_condition("Region", F.col("regions")),
        geo.in_condition("State", F.col("broad")), geo.city_condition(F.col("cities")))))
    return found.withColumn("filter", geo.combine_conditions(conditions))


def clauses(filters: DataFrame) -> DataFrame:
    """The filters as rows ``query_id, clause_no, field, value``; any one clause is enough."""
    def rows(field, values):
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"),
                                                      v.alias("value")))

    cities = F.transform(F.coalesce("cities", F.array().cast(f"array<{geo.CITY}>")),
                         lambda c: F.concat_ws("|", c["city"], c["state"]))
    every = F.array_distinct(F.concat(rows("State", F.col("states")), rows("Region", F.col("regions")),
                                      rows("State", F.col("broad")), rows("City|State", cities)))
    return explode_once(filters, ["query_id"], every, "c", "clause_no").select(
        "query_id", "clause_no", "c.field", "c.value")


_FILTER = "struct<states:array<string>,regions:array<string>,cities:array<string>>"


def _asked(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, vector, filter``: states, regions and ``City|State`` values, of which any one is enough."""
    found = _with_filters(queries.select("query_id", "text", "vector"), docs)
    none = F.array().cast("array<string>")
    cities = F.transform("cities", lambda c: F.concat_ws("|", c["city"], c["state"]))
    return found.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.struct(
        F.array_sort(F.array_distinct(F.concat(F.coalesce("states", none), F.coalesce("broad", none)))).alias("states"),
        F.coalesce("regions", none).alias("regions"), F.coalesce(cities, none).alias("cities")).alias("filter"))


def _place_columns(docs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States, regions and ``City|State``; a missing value is in no filter."""
    text = lambda c: docs[c].fillna("").to_numpy(dtype=str)
    both = docs["City"].notna() & docs["State"].notna()
    cities = np.where(both, docs["City"].fillna("") + "|" + docs["State"].fillna(""), "").astype(str)
    return text("State"), text("Region"), cities


def _usable_vectors(vectors: pd.Series) -> np.ndarray:
    """The length of every vector that can be compared, else 0."""
    return np.array([len(v) if v is not None and len(v) and not pd.isna(np.asarray(v, dtype=float)).any() else 0
                     for v in vectors], dtype=np.int64)


def _nearest_allowed(queries: pd.DataFrame, filters: list[tuple], docs: dict, k: int) -> Iterator[pd.DataFrame]:
    """``docs``: what ``_by_size`` gives of a block.

    Queries meet the documents of each place their filters name, all queries of a place at once; a
    document that stands under several places of a query counts once.
    """
    sizes = _usable_vectors(queries["vector"])
    ids, vectors = queries["query_id"].to_numpy(), queries["vector"].to_numpy()
    for size, (doc_ids, matrix, places) in docs.items():
        rows = np.flatnonzero(sizes == size)
        if not len(rows):
            continue
        own = np.stack(vectors[rows]).astype(float)
        asking: dict[tuple | None, list[int]] = {}
        for at, row in enumerate(rows.tolist()):
            named = [(kind, value) for kind, values in enumerate(filters[row]) for value in dict.fromkeys(values)]
            for place in named or [None]:
                asking.setdefault(place, []).append(at)
        parts = []
        for place, at in asking.items():
            kept = np.arange(len(doc_ids)) if place is None else places.get(place)
            if kept is not None:
                parts.append(_nearest_in_parts(own[at], matrix, kept, k))
                parts[-1]["query_id"] = np.array(at)[parts[-1]["query_id"].to_numpy()]
        if parts:
            best = _first_places(pd.concat(parts, ignore_index=True), k)
            yield pd.DataFrame({"query_id": ids[rows][best["query_id"].to_numpy()],
                                "doc_id": doc_ids[best["doc_id"].to_numpy()], "distance": best["distance"].to_numpy()})


def _by_size(docs: pd.DataFrame) -> dict:
    """Per vector length the ids in order, the vectors as they come, and the rows of every place."""
    sizes, found = _usable_vectors(docs["embedding"]), {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        part = docs[sizes == size].sort_values("doc_id", kind="stable")
        places = {}
        for kind, values in enumerate(_place_columns(part)):
            places.update({(kind, value): rows for value, rows in pd.Series(values).groupby(values).indices.items() if value})
        found[size] = (part["doc_id"].to_numpy(), np.stack(part["embedding"].to_numpy()), places)
    return found


def _filters(column: pd.Series) -> list[tuple]:
    """Filters out of rows or dicts, whichever Arrow gives, as tuples."""
    return [tuple(tuple(f[name]) for name in ("states", "regions", "cities")) for f in column]


def _search_broadcast(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The few documents go to every task; queries stay where they are and nothing is merged."""
    shared = docs.sparkSession.sparkContext.broadcast(_by_size(docs.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            filters = _filters(batch.pop("filter").tolist())
            for found in _nearest_allowed(batch, filters, shared.value, k):
                found["rank"] = found.groupby("query_id", sort=False).cumcount() + 1
                yield found[["query_id", "rank", "doc_id", "distance"]]

    return asked.select("query_id", "vector", "filter").mapInPandas(
        run, "query_id long, rank int, doc_id long, distance double")


def clustered(docs: DataFrame) -> DataFrame:
    """Documents by the one cluster each is in: its state."""
    return docs.select("doc_id", "embedding", "City", "State", "Region", F.coalesce("State", F.lit("")).alias("cluster"))


def clusters_asked(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, vector, filter, cluster``: the clusters in which a query's filter allows documents.

    A state is its cluster, a city lies in the cluster of its state, and a region in those of the
    states that the documents have in it.
    """
    regions = docs.select("Region", F.coalesce("State", F.lit("")).alias("cluster")).filter(
        "Region IS NOT NULL").distinct()
    own = F.array_distinct(F.concat("filter.states", F.transform(
        "filter.cities", lambda c: F.regexp_extract(c, r"(?s)^.*\|(.*)$", 1))))
    direct = asked.select("query_id", F.explode(own).alias("cluster"))
    by_region = (asked.select("query_id", F.explode("filter.regions").alias("Region"))
                 .join(regions, "Region").select("query_id", "cluster"))
    return asked.join(direct.unionByName(by_region).distinct(), "query_id")


def _search_clusters(asked: DataFrame, docs: DataFrame, k: int, block_rows: int) -> DataFrame:
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [] if left.empty or right.empty else list(_nearest_allowed(
            left, _filters(left["filter"].tolist()), _by_size(right), k))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})

    found = compare_in_blocks(clusters_asked(asked, docs), clustered(docs), ["cluster"], "query_id", "doc_id", best,
                              "query_id long, doc_id long, distance double", block_rows)
    return _ranked(found, k)


def filtered_search(queries: DataFrame, docs: DataFrame, k: int = DEFAULT_K, block_rows: int = BLOCK_ROWS,
                    broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """Top ``k`` per query among the documents its own text allows.

    ``queries``: ``query_id, text, vector``; ``docs``: ``doc_id, embedding, City, State,
    Region``.  Documents are counted: while their vectors are few they go to every task, and queries
    are answered where they are.  Beyond that documents lie clustered by state, each in one cluster,
    and queries meet the clusters their filters name, in blocks; queries that name no place are
    compared with all documents.
    """
    check_k(k)
    asked = _asked(queries, docs)
    size = docs.agg(F.sum(F.greatest(F.size("embedding"), F.lit(0)) + F.lit(8)).alias("numbers")).first().numbers or 0
    if size <= broadcast_numbers:
        return _search_broadcast(asked, docs.select("doc_id", "embedding", "City", "State", "Region"), k)
    # texts are read once
    asked = cut_lineage(asked)
    free = F.size("filter.states") + F.size("filter.regions") + F.size("filter.cities") == 0
    named = _search_clusters(asked.filter(~free), docs, k, _rows_of(1, block_rows))
    return named.unionByName(knn_batch(docs, asked.filter(free).drop("filter"), k, block_rows=block_rows))
