"""Prefix trie over conversations, in double arrays.

Conversations become rows of turn identities, and equal ones become one row with a number of members.
These rows are dealt out in ranges of their order, so each shard holds the conversations of one
stretch of prefixes, however common a first turn is.  A shard numbers its turns densely and packs
BASE and CHECK arrays: the child of the node in cell ``s`` by turn ``t`` is cell ``BASE[s] + t``, and
``CHECK`` of that cell is ``s``.  Walks through the arrays find the node of every prefix, and sums go
from the leaves up.

Only nodes on a shard's first and last path can be shared with other shards.  They are handed on with
the sums of what hangs on them, and the paths of all shards are folded in the same way, level by
level, until one small trie of upper nodes is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm.landing import land, table

COPIED = 9                # a conversation takes over up to this many turns, less one
GROUP = 5                 # ids that take over turns from the first id of their group
TURNS = 400_000           # packed into one double array
CHUNK_BITS = 10           # member ids are joined to text in chunks of 2 to this power
RANGE_TURNS = 32          # turns by which ranges are cut
PATHS = 4_000             # paths folded in one task
LEAST_ROWS = 16           # rows in a double array, however long they are
KEYS = 200_000            # upper nodes that are broadcast to name parents
TRIES = 256               # free cells looked at before a node's children go to the end
_NONE = np.iinfo(np.int64).max
_ROOT = hashlib.sha256(b"").digest()[:16]
_NO_ENDS = hashlib.sha256(b"").hexdigest()

TURN = "struct<hi:long,lo:long,bytes:long>"
MARK = "struct<depth:long,n:long,conv:long,kids:long,leaves:long,saved:long,sha:string>"
FOLDED = ("conv_id long, depth long, parent_conv_id long, parent_key binary, own_key binary, n_convs long, "
          f"n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turns array<{TURN}>, "
          f"marks array<{MARK}>")
_LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_TURNS = pa.list_(pa.struct([(f, pa.int64()) for f in ("hi", "lo", "bytes")]))
_MARKS = pa.list_(pa.struct([(f, pa.int64()) for f in ("depth", "n", "conv", "kids", "leaves", "saved")]
                            + [("sha", pa.string())]))


# --- conversations as rows -----------------------------------------------------------------------

def _turn() -> Column:
    """A turn as two halves of a cryptographic digest of role and text, and the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.struct(F.xxhash64(F.substring(digest, 1, 32)).alias("hi"),
                    F.xxhash64(F.substring(digest, 33, 32)).alias("lo"),
                    F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(conversations: DataFrame, group: int = GROUP, copied: int = COPIED) -> DataFrame:
    """``conv_id, turns``: the first turns of the group's first conversation, then the own ones after them.

    All conversations of a group meet in one task by one shuffle of turn identities; texts do not move.
    """
    first = F.col("conv_id") - F.col("conv_id") % group
    rows = (conversations.filter("conv_id IS NOT NULL")
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), _turn().alias("t"))
            .withColumn("first", first).repartition("first"))
    whole = rows.groupBy("first", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("rows"))
    own = whole.select("first", F.struct("conv_id", F.transform("rows", lambda r: r["t"]).alias("own")).alias("c"))
    groups = own.groupBy("first").agg(F.collect_list("c").alias("all"))
    base = F.filter("all", lambda c: c["conv_id"] == F.col("first"))
    head = F.slice(F.coalesce(F.get(base, F.lit(0))["own"], F.array().cast(f"array<{TURN}>")), 1, copied - 1)
    each = groups.withColumn("head", head).select("head", F.explode("all").alias("c"))
    h = (F.crc32(F.col("c.conv_id").cast("string").cast("binary")) % copied).cast("int")
    rest = F.slice(F.col("c.own"), h + 1, F.greatest(F.size("c.own") - h, F.lit(0)))
    return each.select("c.conv_id", F.concat(F.slice(F.col("head"), F.lit(1), h), rest).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """``turns, n, conv, ids``: equal conversations as one row per chunk of member ids, ids ascending."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    return conversations.groupBy("turns", chunk.alias("chunk")).agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.array_join(ids, ",").alias("ids"))


# --- double arrays -------------------------------------------------------------------------------

class Row:
    """A sequence of turns, with what is known at some of its depths."""
    __slots__ = ("turns", "marks")

    def __init__(self, turns: np.ndarray, marks: list[tuple]):
        self.turns, self.marks = turns, marks


class DoubleArray:
    """BASE and CHECK over dense turn ids; the root is cell 0, -1 in CHECK is a free cell or the root."""

    def __init__(self, size: int):
        self.base = np.zeros(size, dtype=np.int64)
        self.check = np.full(size, -1, dtype=np.int64)
        self.used = np.zeros(size, dtype=bool)
        self.used[0] = True
        self.low, self.top = 1, 1      # no free cell below low, no used one from top on

    def _room(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            more = max(more, len(self.base))
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])
            self.used = np.concatenate([self.used, np.zeros(more, dtype=bool)])

    def _take(self, cells: np.ndarray, parents: np.ndarray) -> None:
        self.check[cells] = parents
        self.used[cells] = True
        self.top = max(self.top, int(cells.max()) + 1)

    def _fit(self, codes: np.ndarray) -> int:
        """A base under which all ``codes`` hit free cells: the first found among the free cells."""
        least, span = int(codes.min()), int(codes.max() - codes.min())
        self._room(self.top + span + 1)
        free = self.low + np.flatnonzero(~self.used[self.low:self.low + 4 * TRIES])[:TRIES]
        offsets = codes - least
        for at in range(0, len(free), 32):
            part = free[at:at + 32]
            part = part[part <= self.top]
            if not len(part):
                break
            fits = ~self.used[part[:, None] + offsets[None, :]].any(axis=1)
            if fits.any():
                return int(part[np.argmax(fits)]) - least
        return self.top - least

    def add(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children of one level; those of a parent are neighbours in the list and differ in code."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        count = np.diff(np.concatenate([first, [len(parents)]]))
        for at, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            own = codes[at:at + n]
            base = self._fit(own)
            self.base[parents[at]] = base
            self._take(base + own, parents[at:at + n])
        single = first[count == 1]
        if len(single):
            free = self.low + np.flatnonzero(~self.used[self.low:self.top])[:len(single)]
            self._room(self.top + len(single))
            cells = np.concatenate([free, self.top + np.arange(len(single) - len(free))]).astype(np.int64)
            self.base[parents[single]] = cells - codes[single]
            self._take(cells, parents[single])
            free = np.flatnonzero(~self.used[self.low:self.top])
            self.low = self.low + int(free[0]) if len(free) else self.top

    def step(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children by turn id, -1 where there is none."""
        found = self.base[cells] + codes
        inside = (found > 0) & (found < len(self.check)) & (cells >= 0)
        found = np.where(inside, found, 0)
        return np.where(inside & (self.check[found] == cells), found, -1)


def dense_ids(turns: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for the distinct turns, by their digests."""
    order = np.lexsort((turns[:, 1], turns[:, 0]))
    ranked = turns[order]
    new = np.zeros(len(turns), dtype=np.int64)
    new[1:] = (ranked[1:, :2] != ranked[:-1, :2]).any(axis=1)
    codes = np.empty(len(turns), dtype=np.int64)
    codes[order] = np.cumsum(new)
    return codes


def pack(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> DoubleArray:
    """Double arrays of sequences in ascending order, level by level."""
    trie = DoubleArray(len(codes) + 2)
    active, cells = np.flatnonzero(lengths > 0), np.zeros(len(lengths), dtype=np.int64)
    depth = 0
    while len(active):
        code, parent = codes[starts[active] + depth], cells[active]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (parent[1:] != parent[:-1])])
        trie.add(parent[new], code[new])
        depth += 1
        cells[active] = trie.step(parent, code)
        active = active[lengths[active] > depth]
    return trie


def traverse(trie: DoubleArray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The cell of every prefix: of sequence i from ``starts[i] + i`` on, the root first."""
    cells = np.zeros(len(codes) + len(lengths), dtype=np.int64)
    at = starts + np.arange(len(lengths))
    active, depth = np.flatnonzero(lengths > 0), 0
    while len(active):
        cells[at[active] + depth + 1] = trie.step(cells[at[active] + depth], codes[starts[active] + depth])
        depth += 1
        active = active[lengths[active] > depth]
    return cells


# --- folding -------------------------------------------------------------------------------------

def fold(rows: list[Row], last: bool, named: bool) -> Iterator[pa.RecordBatch]:
    """Nodes of the trie of ``rows``, and its open paths unless it is the ``last``.

    ``named``: the nodes were open before, so others may refer to them by their key.
    """
    lengths = np.array([len(r.turns) for r in rows], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    turns = np.concatenate([r.turns for r in rows])
    codes = dense_ids(turns)
    trie = pack(codes, starts, lengths)
    cells = traverse(trie, codes, starts, lengths)
    at = starts + np.arange(len(rows))
    path = lambda i: cells[at[i]:at[i] + lengths[i] + 1]

    size = len(trie.check)
    depth, weight = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    below = np.ones(len(cells), dtype=bool)
    below[at] = False
    depth[cells] = np.arange(len(cells)) - np.repeat(at, lengths + 1)
    weight[cells[below]] = turns[:, 2]
    n, kids, leaves, saved = (np.zeros(size, dtype=np.int64) for _ in range(4))
    conv = np.full(size, _NONE, dtype=np.int64)
    sha = np.full(size, None, dtype=object)
    places = np.array([at[i] + m[0] for i, r in enumerate(rows) for m in r.marks], dtype=np.int64)
    known = cells[places]
    marks = [m for r in rows for m in r.marks]
    for sums, field in ((n, 1), (kids, 3), (leaves, 4), (saved, 5)):
        np.add.at(sums, known, np.array([m[field] for m in marks], dtype=np.int64))
    np.minimum.at(conv, known, np.array([m[2] for m in marks], dtype=np.int64))
    for cell, mark in zip(known.tolist(), marks):
        if mark[6] is not None:
            sha[cell] = mark[6]

    is_open = np.zeros(size, dtype=bool)
    if not last:
        is_open[path(0)] = is_open[path(len(rows) - 1)] = True
    nodes = np.flatnonzero(depth >= 0)
    nodes = nodes[np.argsort(-depth[nodes], kind="stable")]
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(depth[nodes]) != 0, [True]]))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        level = nodes[low:high]
        level = level[~is_open[level]]
        leaves[level] = np.where(kids[level] == 0, 1, leaves[level])
        saved[level] += (n[level] - 1) * weight[level]
        level = level[level > 0]
        up = trie.check[level]
        for sums, add in ((n, n[level]), (leaves, leaves[level]), (saved, saved[level]), (kids, 1)):
            np.add.at(sums, up, add)
        np.minimum.at(conv, up, conv[level])

    # keys of nodes that are open, or were
    keys = np.full(size, None, dtype=object)
    keys[0] = _ROOT
    for i in (range(len(rows)) if named else [0, len(rows) - 1]):
        for step, turn in zip(path(i)[1:].tolist(), rows[i].turns):
            if keys[step] is None:
                keys[step] = hashlib.sha256(keys[trie.check[step]] + turn[:2].tobytes()).digest()[:16]

    closed = nodes[~is_open[nodes]]
    up = trie.check[closed]
    under_open = (up >= 0) & is_open[up]
    told = {"conv_id": pa.array(conv[closed]), "depth": pa.array(depth[closed]),
            "parent_conv_id": pa.array(conv[np.maximum(up, 0)], mask=(up < 0) | under_open),
            "parent_key": pa.array([k if o else None for k, o in zip(keys[np.maximum(up, 0)], under_open)], pa.binary()),
            "own_key": pa.array(keys[closed] if named else [None] * len(closed), pa.binary()),
            "n_convs": pa.array(n[closed]), "n_children": pa.array(kids[closed]), "n_leaves": pa.array(leaves[closed]),
            "saved_tokens": pa.array(saved[closed]), "ends_sha256": pa.array(sha[closed], pa.string()),
            "turns": pa.nulls(len(closed), _TURNS), "marks": pa.nulls(len(closed), _MARKS)}
    yield pa.RecordBatch.from_pydict(told)
    if last:
        return
    told, paths = set(), []
    for i in dict.fromkeys([0, len(rows) - 1]):
        own = [(d, c) for d, c in enumerate(path(i).tolist()) if c not in told and (n[c] or kids[c])]
        told.update(c for _, c in own)
        paths.append((rows[i].turns, [(d, n[c], conv[c], kids[c], leaves[c], saved[c], sha[c]) for d, c in own]))
    yield _path_batch(paths)


def _path_batch(paths: list[tuple[np.ndarray, list[tuple]]]) -> pa.RecordBatch:
    none = {name: pa.nulls(len(paths), pa.int64()) for name in _LONGS}
    none |= {name: pa.nulls(len(paths), pa.binary()) for name in ("parent_key", "own_key")}
    none["ends_sha256"] = pa.nulls(len(paths), pa.string())
    none["turns"] = pa.array([[dict(zip(("hi", "lo", "bytes"), map(int, t))) for t in turns] for turns, _ in paths], _TURNS)
    names = ("depth", "n", "conv", "kids", "leaves", "saved", "sha")
    none["marks"] = pa.array([[dict(zip(names, [*map(int, m[:6]), m[6]])) for m in marks] for _, marks in paths], _MARKS)
    order = [part.split()[0] for part in FOLDED.split(", ")]
    return pa.RecordBatch.from_pydict({name: none[name] for name in order})


def _turn_rows(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    flat = column.values
    values = np.stack([flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in range(3)], axis=1)
    return column.offsets.to_numpy(), values


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[Row]:
    """Sequences out of their sorted chunks; the members' digest is taken chunk by chunk."""
    before = None

    def done() -> Row:
        turns, n, conv, digest = before
        return Row(turns, [(len(turns), n, conv, 0, 0, 0, digest.hexdigest())])

    for batch in batches:
        offsets, values = _turn_rows(batch.column("turns"))
        rows = zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("n").to_pylist(),
                   batch.column("conv").to_pylist(), batch.column("ids").to_pylist())
        for low, high, n, conv, ids in rows:
            if (before is not None and len(before[0]) == high - low
                    and np.array_equal(before[0], values[low:high])):
                before[3].update(b"," + ids.encode())
                before = (before[0], before[1] + n, min(before[2], conv), before[3])
                continue
            if before is not None:
                yield done()
            before = (values[low:high], n, conv, hashlib.sha256(ids.encode()))
    if before is not None:
        yield done()


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[Row]:
    names = ("depth", "n", "conv", "kids", "leaves", "saved", "sha")
    for batch in batches:
        offsets, values = _turn_rows(batch.column("turns"))
        for i, marks in enumerate(batch.column("marks").to_pylist()):
            yield Row(values[offsets[i]:offsets[i + 1]], [tuple(m[f] for f in names) for m in marks])


def folded(rows: DataFrame, paths: bool, last: bool) -> DataFrame:
    """Sorted partitions folded, in tries of at most ``TURNS`` turns, or in one if it is the ``last``."""
    read, most = (_paths if paths else _whole), TURNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in read(batches):
            # a fold gives back two paths at most, so it pays from a few rows on
            if size > most and len(held) >= LEAST_ROWS and not last:
                yield from fold(held, False, paths)
                held, size = [], 0
            held.append(row)
            size += len(row.turns)
        if held:
            yield from fold(held, last, paths)

    return rows.mapInArrow(run, FOLDED)


def _sorted(rows: DataFrame, parts: int, *more: str) -> DataFrame:
    return rows.repartitionByRange(parts, F.slice("turns", 1, RANGE_TURNS)).sortWithinPartitions("turns", *more)


def trie(rows: DataFrame) -> DataFrame:
    """``turns, chunk, n, conv, ids`` -> one row per node of the trie."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = land(folded(_sorted(land(rows, "sequences"), parts, "chunk"), False, False), "trie")
    nodes = found.filter("turns IS NULL")
    paths = found.filter("turns IS NOT NULL").select("turns", "marks")
    while (count := paths.count()) > PATHS:
        found = land(folded(_sorted(paths, -(-count // max(PATHS // 2, LEAST_ROWS))), True, False), "trie")
        nodes = nodes.unionByName(found.filter("turns IS NULL"))
        if (left := found.filter("turns IS NOT NULL").count()) >= count:
            raise RuntimeError("open paths do not become fewer")
        paths = found.filter("turns IS NOT NULL").select("turns", "marks")
    top = land(folded(paths.repartition(1).sortWithinPartitions("turns"), True, True), "trie")
    nodes = nodes.unionByName(top).drop("turns", "marks")
    names = nodes.filter("own_key IS NOT NULL").select(F.col("own_key").alias("parent_key"),
                                                       F.col("conv_id").alias("_parent"))
    if names.count() <= KEYS:
        names = F.broadcast(names)
    under = (nodes.filter("parent_key IS NOT NULL").join(names, "parent_key")
             .withColumn("parent_conv_id", F.col("_parent")).drop("_parent"))
    return nodes.filter("parent_key IS NULL").unionByName(under).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth, parent_conv_id`` and its sums.

    Turns of a conversation are ordered by ``turn``, null first; turns with the same number by their
    digests, so that repeated rows are turns of their own and their order is the same in every run.
    A null role or text is empty.  Rows without ``conv_id`` belong to no conversation.  An empty table
    has no nodes.  Ids are whole numbers.  Only ``conv_id, turn, role, text`` are read.

    A conversation's turns must fit in a task as identities of 24 bytes; texts are never gathered.
    """
    return trie(sequences(rebuilt(conversations)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}

_SQL = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY p) AS turns FROM o GROUP BY 1),
h AS (SELECT conv_id, turns, (xor(list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], list_transform(range(8), lambda z: 0::BIGINT)),
          lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)),
        4294967295::BIGINT) % 9)::BIGINT AS h FROM own),
s AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS s
      FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, len(s) AS n, s[1:d] AS k, s[1:d - 1] AS up, CASE WHEN d > 0 THEN strlen(s[d].t) ELSE 0 END AS b
      FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
g AS (SELECT k, d, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
             any_value(b) AS b,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends
      FROM p GROUP BY k, d),
c AS (SELECT up AS k, count(*) AS n_children FROM g WHERE up IS NOT NULL GROUP BY 1),
f AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN c USING (k)),
t AS (SELECT a, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * b) AS saved
      FROM (SELECT k[1:unnest(range(0, d + 1))] AS a, n_children, n_convs, b FROM f) GROUP BY a)
SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
       f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       f.ends AS ends_sha256
FROM f JOIN t ON t.a = f.k LEFT JOIN f u ON u.k = f.up
"""

SQL = {"op12_prefix_trie": _SQL}
