"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from placesearch.llm.landing import dealt_anew, land

_MOST_ROUNDS = 60
_FEW = 1 << 17        # links of two numbers, 2 MB, that are not worth a shuffle


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (long) -> ``node, component``: each node's smallest reachable node.

    Every round links the neighbours of a node to the smallest of them, first the larger ones, then
    the smaller ones, so long chains halve and a star of any size stays one row per node.  The
    smallest neighbour is an aggregate that each task prepares; rows of a busy node can be split.
    A fixed small number of links stays in one partition instead, where a round needs no exchange.
    """
    edges = land(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .filter("u <> v").distinct(), "edges")
    before, rows = None, edges.count()
    for _ in range(_MOST_ROUNDS):
        few = rows <= _FEW
        edges = land(_small_star(_large_star(edges, few), few), "edges")
        # hashes of all rows, wrapped at 2^63, as a sign that nothing changed
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")),
                              F.sum(F.xxhash64("v", "u") % 1_000_003)).first())
        if now == before:
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
                                 .distinct()))
        before, rows = now, now[0]
    raise RuntimeError("components did not settle")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Neighbours above a node go to the smallest of it and its neighbours."""
    told = _with_least(_placed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), few), few)
    return (told.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """A node and its neighbours below go to the smallest of them; rows have ``u > v``."""
    told = _with_least(edges, few)
    both = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                             F.struct("u", F.col("m").alias("v"))))
    return told.select(both.alias("_e")).select("_e.*").filter("u <> v").distinct()


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """Adds ``m``, the smallest ``v`` of each ``u``."""
    if few:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return edges.join(dealt_anew(edges.groupBy("u").agg(F.min("v").alias("m"))), "u")


def _placed(edges: DataFrame, few: bool) -> DataFrame:
    return edges.coalesce(1) if few else edges
