"""Packing token rows into windows by multiway differencing.

Whole windows are cut off the front of each document.  What is left is cut into pieces, and the
pieces of a group of documents are divided into as few windows as can hold them by Karmarkar-Karp
differencing: partial partitions are merged, the two most uneven first, so that the fullest window
of one meets the emptiest of the other.  The windows come out nearly equal; if one exceeds its
capacity, the number of windows rises and the division starts again.

A group is a run of documents in one task, so nothing is shuffled, memory is bounded by the group,
and a task that is run again gives the same windows.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from placesearch.llm.landing import map_texts, table
from placesearch.llm.tokens import encoder, together

WINDOW = 2048
END = 1               # fixed value: id after each document
PIECE = 512           # longest piece of what does not fill a window
GROUP = 256           # documents divided together, at least; twice as many at most
ROOM = (4, 10)        # free tokens per window at which a group may end
FINE = 4              # of so many documents, one is cut into halves, quarters and so on of a window,
                      # whose small pieces even out the windows
_TASK_BITS = 40       # windows of one task
_COLUMNS = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
            "sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def difference(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each item: Karmarkar-Karp differencing of ``sizes`` into ``windows`` parts."""
    # a part of a partial partition is a node: an item, or two parts put together
    kids: list[tuple[int, int]] = []
    count = len(sizes)
    # sums, negated, and nodes of the parts in use, the fullest first; other parts are empty
    cells = {i: ([-size], [i]) for i, size in enumerate(sizes)}
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = count
    while len(heap) > 1:
        sums, nodes = cells.pop(heapq.heappop(heap)[1])
        added, theirs = cells.pop(heapq.heappop(heap)[1])
        if len(added) == 1:
            # into the emptiest part, which then moves up to its place
            total, node = added[0], theirs[0]
            if len(sums) == windows:
                total += sums.pop()
                kids.append((nodes.pop(), node))
                node = count + len(kids) - 1
            at = bisect.bisect_right(sums, total)
            sums.insert(at, total)
            nodes.insert(at, node)
        else:
            # the fullest part of one with the emptiest of the other
            alone = min(len(sums), windows - len(added))
            shared = len(sums) - alone
            added, theirs = added[::-1], theirs[::-1]
            made = count + len(kids)
            kids += zip(nodes[alone:], theirs)
            sums = sums[:alone] + [a + b for a, b in zip(sums[alone:], added)] + added[shared:]
            nodes = nodes[:alone] + list(range(made, made + shared)) + theirs[shared:]
            order = sorted(range(len(sums)), key=sums.__getitem__)
            sums, nodes = [sums[i] for i in order], [nodes[i] for i in order]
        cells[number] = (sums, nodes)
        # the most uneven first
        heapq.heappush(heap, (sums[0] - (sums[-1] if len(sums) == windows else 0), number))
        number += 1
    window = [0] * (count + len(kids))
    for at, node in enumerate(next(iter(cells.values()))[1]):
        window[node] = at
    for node in range(len(kids) - 1, -1, -1):
        one, other = kids[node]
        window[one] = window[other] = window[count + node]
    return np.array(window[:count], dtype=np.int64)


def divide(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each item, none fuller than ``capacity``; items must fit alone."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, windows)
        if np.bincount(found, weights=sizes, minlength=windows).max() <= capacity:
            return found
        windows += max(1, windows // 256)


def cuts(tokens: int, window: int, piece: int, fine: bool) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces: whole windows, then nearly equal smaller ones.

    ``fine``: what does not fill a window is cut into ever smaller halves of a window instead.
    """
    whole = tokens // window
    lengths = [window] * whole
    rest = tokens - whole * window
    if fine:
        half = window
        while rest:
            half = max(1, half // 2)
            lengths += [half] * (rest // half)
            rest %= half
    elif rest:
        parts = -(-rest // piece)
        lengths += [rest // parts + (i < rest % parts) for i in range(parts)]
    starts = np.cumsum([0, *lengths])[:-1].tolist()
    return list(zip(starts, lengths))


def _ends(documents: int, tokens: int, window: int, group: int) -> bool:
    """Whether a group ends here: its windows leave little room, but enough to come out even."""
    if documents < group or documents >= 2 * group:
        return documents >= 2 * group
    windows = -(-tokens // window)
    return ROOM[0] * windows <= windows * window - tokens <= ROOM[1] * windows


def pack(docs: DataFrame, path: str, window: int = WINDOW, piece: int = PIECE, group: int = GROUP,
         ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    With ``ids`` a column ``ids`` holds the piece's token ids.  A document is its text's ids and an
    end id; a null or empty text is the end id alone.  Rows that repeat a ``doc_id`` are packed
    each; a missing ``doc_id`` stays null.  Pieces of one window have gapless offsets from 0.  Only
    ``doc_id`` and ``text`` are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        next_id = TaskContext.get().partitionId() << _TASK_BITS
        rows: list[tuple] = []
        waiting: list[tuple] = []
        documents = loose = 0

        def flush() -> None:
            nonlocal next_id, documents, loose
            if waiting:
                place = divide([r[2] for r in waiting], window)
                filled = np.zeros(place.max() + 1, dtype=np.int64)
                for row, at in zip(waiting, place.tolist()):
                    rows.append((*row[:5], next_id + at, int(filled[at]), *row[5:]))
                    filled[at] += row[2]
                next_id += int(place.max()) + 1
            waiting.clear()
            documents = loose = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in together(batches):
            for doc_id, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).fill_null(""))):
                data += END.to_bytes(4, "little")
                tokens = len(data) // 4
                for start, length in cuts(tokens, window, piece, documents % FINE == 0):
                    part = data[4 * start:4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(part), tokens)
                    if ids:
                        row += (np.frombuffer(part, dtype="<u4").astype(np.int32),)
                    if length == window:
                        rows.append((*row[:5], next_id, 0, *row[5:]))
                        next_id += 1
                    else:
                        waiting.append(row)
                        loose += length
                documents += 1
                if _ends(documents, loose, window, group):
                    flush()
                    if len(rows) >= 4096 or ids:
                        yield out()
        flush()
        if rows:
            yield out()

    schema = _COLUMNS + (", ids array<int>" if ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}
