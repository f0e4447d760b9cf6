"""Nearest documents by squared Euclidean distance; ties go to the lower document id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from placesearch.operators.blocks import BLOCK_ROWS, compare_in_blocks, merge_best

RECALL_FLOOR = 0.9     # of the approximate search
DEFAULT_K = 4          # fixed values: results per query
MAX_K = 10
BROADCAST_NUMBERS = 2_000_000     # query vectors are broadcast up to 16 MB of doubles
BLOCK_BYTES = 64 << 20            # of the vectors on one side of a task
BLOCK_VECTORS = 131_072           # documents of a task, whose vectors are compared in parts
_ROWS_AT_ONCE = 256
_NUMBERS_AT_ONCE = 4_000_000
_GROUP = 32               # columns of a rough product whose smallest is taken
_FOUND = "query_id long, doc_id long, distance double"


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be 1 to {MAX_K}")
    return k


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")),
                       F.lit(0.0), lambda total, d: total + d * d)


def _whole(vector: str, dims: int) -> Column:
    """The vector has this many numbers and no null or NaN among them."""
    return (F.size(vector) == dims) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def _usable(docs: DataFrame, dims: int, where: Column | None = None) -> DataFrame:
    """Documents the filter keeps whose vector can be compared; any other is near to nothing."""
    docs = docs.filter(F.coalesce(_whole("embedding", dims), F.lit(False)))
    return docs if where is None else docs.filter(where)


def _by_length(queries: DataFrame) -> list[tuple[int, DataFrame]]:
    """Queries by the length of their vector; those that cannot be compared are left out."""
    sizes = [r.n for r in queries.select(F.size("vector").alias("n")).distinct().filter("n > 0").collect()]
    return [(n, queries.filter(F.coalesce(_whole("vector", n), F.lit(False)))) for n in sorted(sizes)]


def knn(docs: DataFrame, vector: list[float] | None, k: int = DEFAULT_K,
        where: Column | None = None) -> DataFrame:
    """The ``k`` documents nearest to one query vector, with rank and distance.

    ``docs``: ``doc_id, embedding`` and metadata.  The filter goes to the scan before any
    distance is computed; each task keeps its own ``k`` best.
    """
    check_k(k)
    if not vector or any(x is None or x != x for x in vector):
        docs, vector = docs.filter(F.lit(False)), []
    docs = _usable(docs, len(vector), where)
    query = F.array(*[F.lit(float(v)) for v in vector]).cast("array<double>")
    near = (docs.withColumn("distance", squared_distance(F.col("embedding"), query))
            .orderBy("distance", "doc_id").limit(k))
    others = [c for c in docs.columns if c not in ("doc_id", "embedding")]
    metadata = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("m")
    # at most k rows are left here
    best = near.agg(F.array_sort(F.collect_list(F.struct("distance", "doc_id", metadata)))
                    .alias("hits"))
    ranked = best.select(F.posexplode("hits").alias("pos", "h"))
    return ranked.select((F.col("pos") + 1).alias("rank"), F.col("h.doc_id").alias("doc_id"),
                         F.col("h.distance").alias("distance"),
                         *[F.col(f"h.m.`{c}`").alias(c) for c in others])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def _bound(rough: np.ndarray, k: int) -> np.ndarray:
    """At least the ``k``-th smallest number of each row: that of the smallest ones of groups of columns."""
    groups = rough.shape[1] // _GROUP
    if groups < k:
        return np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
    least = rough[:, :groups * _GROUP].reshape(len(rough), groups, _GROUP).min(axis=2)
    return np.partition(least, k - 1, axis=1)[:, k - 1]


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
             k: int, limit: np.ndarray | None = None) -> pd.DataFrame:
    """The ``k`` nearest rows of one block of documents to each query, nearest first.

    A matrix product of short numbers finds the rows that can be among the nearest; their distances are
    then computed term by term, the same way in every block.  ``limit``: distances beyond which a query
    needs no row.
    """
    # a common shift changes no distance and keeps the rounding error of the product small
    centre, dims = vectors.mean(axis=0), vectors.shape[1]
    near_zero = vectors - centre
    lengths, found = (near_zero ** 2).sum(axis=1), []
    # numbers whose squares short ones cannot hold are multiplied as they are
    short = 1e-10 < np.abs(near_zero).max() < 1e15 and np.abs(queries - centre).max(initial=0) < 1e15
    kind = np.float32 if short else np.float64
    # the product with a last column of squared lengths is the squared distance less the query's own length
    right = np.ascontiguousarray(np.column_stack([near_zero, lengths]).astype(kind).T)
    rows = max(_ROWS_AT_ONCE, _ROWS_AT_ONCE * BLOCK_ROWS // len(ids))
    for at in range(0, len(queries), rows):
        part = queries[at:at + rows]
        moved = part - centre
        own = (moved ** 2).sum(axis=1)
        rough = np.column_stack([-2 * moved, np.ones(len(part))]).astype(kind) @ right
        # rounding grows with the squared lengths and the number of terms
        slack = 8 * (dims + 4) * (np.finfo(kind).eps * (own + lengths.max()) + np.finfo(float).eps * (
            np.abs(vectors).max() + np.abs(part).max()) ** 2)
        known = np.full(len(part), np.inf) if limit is None else limit[at:at + len(part)]
        most = known - own + slack
        if np.isinf(known).any():
            most = np.minimum(most, _bound(rough, k) + 2 * slack)
        # rounded up; every row within the limit is looked at, however many share one distance
        near = np.flatnonzero(~(rough > np.nextafter(most.astype(kind), kind(np.inf))[:, None]))
        row, doc = near // len(ids), near % len(ids)
        if not len(near):
            continue
        step = max(1, _NUMBERS_AT_ONCE // dims)
        exact = np.concatenate([((vectors[doc[i:i + step]] - part[row[i:i + step]]) ** 2).sum(axis=-1)
                                for i in range(0, len(near), step)])
        order = np.lexsort((ids[doc], exact, row))
        row = row[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        kept = np.arange(len(row)) - np.repeat(first, np.diff([*first, len(row)])) < k
        order = order[kept]
        found.append((query_ids[at + row[kept]], ids[doc[order]], exact[order]))
    columns = [np.concatenate(c) for c in zip(*found)] or [query_ids[:0], ids[:0], np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "doc_id", "distance"), columns)))


def _first_places(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of each query, a row that was found several times once."""
    asked, doc, far = (found[c].to_numpy() for c in ("query_id", "doc_id", "distance"))
    order = np.lexsort((doc, far, asked))
    asked, doc = asked[order], doc[order]
    new = np.concatenate([[True], (asked[1:] != asked[:-1]) | (doc[1:] != doc[:-1])])[:len(order)]
    order, asked = order[new], asked[new]
    first = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])[:len(order)])
    place = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
    return found.iloc[order[place < k]]


def _nearest_in_parts(queries: np.ndarray, matrix: np.ndarray, rows: np.ndarray, k: int,
                      known: np.ndarray | float = np.inf) -> pd.DataFrame:
    """The ``k`` nearest of some rows of a large block: places of queries and of rows, and the distance.

    ``known``: distances beyond which a query needs no row.
    """
    asked, kept, limit = np.arange(len(queries)), None, np.broadcast_to(known, len(queries))
    for at in range(0, len(rows), BLOCK_ROWS):
        part = rows[at:at + BLOCK_ROWS]
        kept = _kept_best(kept, _nearest(asked, queries, part, matrix[part].astype(np.float64), k, limit), k)
        limit = np.minimum(known, _last_of(kept, len(queries), k))
    return pd.DataFrame({"query_id": asked[:0], "doc_id": rows[:0], "distance": []}) if kept is None else kept


def _last_of(kept: pd.DataFrame, queries: int, k: int) -> np.ndarray:
    """The distance of the ``k``-th row of each query, infinite where there are fewer; rows stand by query, nearest first."""
    asked = kept["query_id"].to_numpy()
    ends = np.searchsorted(asked, np.arange(queries), side="right")
    full = ends - np.searchsorted(asked, np.arange(queries)) >= k
    limit = np.full(queries, np.inf)
    limit[full] = kept["distance"].to_numpy()[ends[full] - 1]
    return limit


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return merge_best(found, ["query_id"], [F.col("distance"), F.col("doc_id")], "doc_id", k)


def _kept_best(kept: pd.DataFrame | None, near: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest of each query among what was kept and what is new."""
    if kept is None:
        return near
    both = pd.concat([kept, near], ignore_index=True)
    order = np.lexsort((both["doc_id"].to_numpy(), both["distance"].to_numpy(), both["query_id"].to_numpy()))
    ids = both["query_id"].to_numpy()[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    place = np.arange(len(ids)) - np.repeat(first, np.diff([*first, len(ids)]))
    return both.iloc[order[place < k]]


def _knn_broadcast(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Documents stay where they are; the few queries go to every task."""
    rows = queries.toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(
        (rows["query_id"].to_numpy(), _matrix(rows["vector"])))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = shared.value
        kept, held, size = None, [], 0
        for batch in batches:
            if len(batch) and len(ids):
                held.append(batch)
                size += len(batch)
            # batches are taken together, so the merge is rare
            if size >= BLOCK_ROWS:
                kept, held, size = _merged(kept, held, ids, vectors, k), [], 0
        if held:
            kept = _merged(kept, held, ids, vectors, k)
        if kept is not None:
            yield kept

    return _ranked(docs.mapInPandas(best, _FOUND), k)


def _merged(kept: pd.DataFrame | None, held: list[pd.DataFrame], ids: np.ndarray, vectors: np.ndarray,
            k: int) -> pd.DataFrame:
    docs = pd.concat(held, ignore_index=True)
    return _kept_best(kept, _nearest(ids, vectors, docs["doc_id"].to_numpy(), _matrix(docs["embedding"]), k), k)


def _knn_blocks(docs: DataFrame, queries: DataFrame, keys: list[str], k: int,
                block_rows: int, doc_rows: int | None = None) -> DataFrame:
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "distance": []})
        right = right.sort_values("doc_id", kind="stable")
        near = _nearest_in_parts(_matrix(left["vector"]), np.stack(right["embedding"].to_numpy()), np.arange(len(right)), k)
        return _named(near, left, right)

    return _best_once(compare_in_blocks(queries, docs, keys, "query_id", "doc_id", best, _FOUND, block_rows, doc_rows), k)


def _named(near: pd.DataFrame, queries: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    """Ids for places."""
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[near["query_id"].to_numpy()],
                         "doc_id": docs["doc_id"].to_numpy()[near["doc_id"].to_numpy()], "distance": near["distance"].to_numpy()})


def _best_once(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest; one document may be reached by several keys of the same query."""
    return _ranked(found.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance")), k)


def _rows_of(dims: int, block_rows: int) -> int:
    """Rows of a block: bounded in number and in the bytes of their vectors."""
    return max(1, min(block_rows, BLOCK_BYTES // (8 * max(dims, 1))))


def _doc_rows(dims: int, block_rows: int) -> int:
    """Documents of a block: many, unless small blocks are asked for."""
    return _rows_of(dims, BLOCK_VECTORS if block_rows >= BLOCK_ROWS else block_rows)


def _together(parts: list[DataFrame], docs: DataFrame) -> DataFrame:
    if not parts:
        return docs.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, distance double")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return found


def knn_batch(docs: DataFrame, queries: DataFrame, k: int = DEFAULT_K,
              where: Column | None = None, broadcast_numbers: int = BROADCAST_NUMBERS,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest documents of each query: ``query_id, rank, doc_id, distance``.

    ``queries``: ``query_id, vector``.  Queries are counted first: while their vectors are few
    they are broadcast and documents are not moved; beyond that both sides meet in blocks.  A
    vector with a null or NaN, or of another length than the query's, is near to nothing.
    """
    check_k(k)
    parts = []
    for dims, asked in _by_length(queries.select("query_id", "vector")):
        seen = _usable(docs, dims, where).select("doc_id", "embedding")
        if asked.count() * dims <= broadcast_numbers:
            parts.append(_knn_broadcast(seen, asked, k))
        else:
            parts.append(_knn_blocks(seen, asked, [], k, _rows_of(dims, block_rows), _doc_rows(dims, block_rows)))
    return _together(parts, docs)


def knn_keyed(docs: DataFrame, queries: DataFrame, keys: list[str], k: int = DEFAULT_K,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As ``knn_batch``, but a query sees only documents that share a key with it.

    Both sides may list a row under several keys.
    """
    check_k(k)
    return _together([
        _knn_blocks(_usable(docs, dims).select("doc_id", "embedding", *keys), asked, keys, k,
                    _rows_of(dims, block_rows))
        for dims, asked in _by_length(queries.select("query_id", "vector", *keys))], docs)


def recall(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    hit = approx.select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "doc_id"], "left").agg(
        F.count("*").alias("expected"), F.count("hit").alias("found"),
        (F.count("hit") / F.count("*")).alias("recall"))
