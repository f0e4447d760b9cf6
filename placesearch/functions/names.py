"""Names, states in addresses, and how alike two names are."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from placesearch.functions.text import SPACE, strip

_AT_ONCE = 64      # names of highest bound that are compared first


def merge_key(name: Column) -> Column:
    return F.lower(strip(name))


def extract_state(address: Column) -> Column:
    """Two capitals at the end or before a ZIP code, else two capitals after a comma."""
    at_end = F.regexp_extract(address, rf"([A-Z]{{2}})(?:(?d:$)|{SPACE}+\p{{Nd}}{{5}})", 1)
    after_comma = F.regexp_extract(address, rf",{SPACE}*([A-Z]{{2}})(?:(?d:$)|{SPACE})", 1)
    return F.coalesce(F.nullif(at_end, F.lit("")), F.nullif(after_comma, F.lit("")))


def token_sort(name: Column) -> Column:
    """The words of a name in order, joined by a blank."""
    words = F.split(strip(name), rf"{SPACE}+", -1)
    return F.array_join(F.array_sort(words), " ")


def score(lcs: Column, length: Column) -> Column:
    """0 to 100 from the longest common subsequence and the summed lengths."""
    return F.when(length == 0, 100.0).otherwise(F.lit(200.0) * lcs / length)


def _codes(names: list[str]) -> tuple[np.ndarray, dict[str, int]]:
    """Names as rows of character numbers, filled up with 0."""
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(names))))}
    rows = np.zeros((len(names), max(map(len, names), default=0)), dtype=np.int64)
    for i, name in enumerate(names):
        rows[i, :len(name)] = [alphabet[c] for c in name]
    return rows, alphabet


def _common(name: str, codes: np.ndarray, alphabet: dict[str, int]) -> np.ndarray:
    """Longest common subsequence of ``name`` with many coded names, a column at a time."""
    wide = object if len(name) > 64 else np.uint64
    places = np.zeros(len(alphabet) + 1, dtype=wide)
    for i, c in enumerate(name):
        if c in alphabet:
            places[alphabet[c]] |= wide(1 << i) if wide is np.uint64 else 1 << i
    full = (1 << len(name)) - 1
    open_ = np.full(len(codes), full, dtype=wide)
    for column in codes.T:
        hit = open_ & places[column]
        open_ = (open_ + hit) | (open_ - hit)
        if wide is object:
            open_ &= full
    left = open_ & (np.uint64(full) if wide is np.uint64 else full)
    count = np.bitwise_count(left) if wide is np.uint64 else np.array([v.bit_count() for v in left])
    return len(name) - count.astype(np.int64)


def common_length(a: str, b: str) -> int:
    """Longest common subsequence of two names, by one number of as many bits as ``a`` has letters."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def most_alike(left: list[str], left_bags: np.ndarray, floor: np.ndarray, right: list[str],
               right_bags: np.ndarray, position: np.ndarray) -> pd.DataFrame:
    """For each left name the most alike right name that scores its floor, ties to the lower position.

    ``row, name, position, lcs, length``.  Bags count letters, which bounds the score: a right name is
    compared in full only while its bound reaches the best score so far, or the floor.
    """
    codes, alphabet = _codes(right)
    sizes, found = np.array([len(n) for n in right]), []
    for row, (name, bag, least) in enumerate(zip(left, left_bags, floor)):
        total = np.maximum(sizes + len(name), 1)
        bound = 200.0 * np.minimum(right_bags, bag).sum(axis=1) / total
        best, chosen, seen = least - 1e-9, None, np.zeros(len(right), dtype=bool)
        first = np.argsort(-bound, kind="stable")[:_AT_ONCE]
        first = first[bound[first] >= best]
        while len(first):
            seen[first] = True
            lcs = _common(name, codes[first], alphabet)
            ratio = 200.0 * lcs / total[first]
            top = np.lexsort((position[first], -ratio))[0]
            if ratio[top] > best or (chosen is not None and ratio[top] == best
                                     and position[first[top]] < position[chosen[0]]):
                best, chosen = ratio[top], (first[top], int(lcs[top]))
            first = np.flatnonzero((bound >= best) & ~seen)
        if chosen is not None:
            found.append((row, name, position[chosen[0]], chosen[1], sizes[chosen[0]] + len(name)))
    return pd.DataFrame(found, columns=["row", "name", "position", "lcs", "length"])
