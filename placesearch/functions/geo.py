"""Places named in query text, and the filter conditions made from them."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column, functions as F

from placesearch.functions.lexicon import BROAD_REGIONS, REGION_ALIASES, state_aliases
from placesearch.functions.text import bind

CITY = "struct<city:string,state:string>"


def _either(phrases: list[str]) -> str:
    """A pattern for any of the phrases, longer ones first; common beginnings are tried once."""
    rests: dict[str, list[str]] = {}
    for phrase in phrases:
        if phrase:
            rests.setdefault(phrase[0], []).append(phrase[1:])
    parts = []
    for letter, rest in sorted(rests.items()):
        own = letter if letter in " -" else re.escape(letter)
        parts.append(own + (_either(rest) if any(rest) else ""))
    inner = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
    return f"(?:{inner})?" if "" in phrases else inner


def _mentions(text: Column, phrases) -> Column:
    """The phrases that stand in a text as whole words.

    The look-ahead tries every position, so phrases may overlap ("west virginia" also names
    "virginia").  Of two phrases that start alike the longer is reported.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)(?=\b({_either(list(phrases))})\b)"), F.lit(1))
    return F.array_distinct(found)


def _lookup(mapping: dict[str, str], keys: Column) -> Column:
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.sort_array(F.array_distinct(F.transform(keys, lambda k: pairs[k])))


def state_codes(text: Column) -> Column:
    """Codes of the states a query names, sorted."""
    aliases = state_aliases()
    return _lookup(aliases, _mentions(text, aliases))


def region_names(text: Column) -> Column:
    """Directory regions a query names, sorted."""
    return _lookup(REGION_ALIASES, _mentions(text, REGION_ALIASES))


def broad_states(text: Column) -> Column:
    """States of the wider areas a query names; empty if it names a directory region."""
    areas = F.create_map(*chain.from_iterable(
        (F.lit(name), F.array(*[F.lit(s) for s in states]))
        for name, states in BROAD_REGIONS.items()))
    states = F.flatten(F.transform(_mentions(text, BROAD_REGIONS), lambda k: areas[k]))
    none = F.array().cast("array<string>")
    return F.when(F.size(region_names(text)) > 0, none).otherwise(
        F.sort_array(F.array_distinct(states)))


def in_condition(field: str, values: Column) -> Column:
    """``{field: {"$in": values}}`` as JSON; null without values."""
    return F.when(F.size(values) > 0,
                  F.to_json(F.struct(F.struct(values.alias("$in")).alias(field))))


def _equals(field: str, value: Column) -> Column:
    return F.to_json(F.struct(value.alias(field)))


def _any_of(conditions: Column) -> Column:
    return F.when(F.size(conditions) == 1, conditions[0]).when(
        F.size(conditions) > 1,
        F.concat(F.lit('{"$or":['), F.array_join(conditions, ","), F.lit("]}")))


def unique_cities(cities: Column) -> Column:
    """First of each city and state, compared without case, in the given order."""
    keys = F.transform(cities, lambda c: F.concat_ws(
        "\n", F.lower(c["city"]), F.upper(F.coalesce(c["state"], F.lit("")))))
    return F.filter(cities, lambda c, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def city_condition(cities: Column) -> Column:
    """Filter condition for a list of cities with or without a state; null without cities."""
    def one(c: Column) -> Column:
        both = F.concat(F.lit('{"$and":['), _equals("City", c["city"]), F.lit(","),
                        _equals("State", c["state"]), F.lit("]}"))
        return F.when(F.coalesce(c["state"], F.lit("")) != "", both).otherwise(
            _equals("City", c["city"]))

    return _any_of(F.transform(unique_cities(cities), one))


def canonical_json(text: Column) -> Column:
    """The same JSON with the keys of every object in order."""
    return F.to_json(F.parse_json(text))


def dedupe_conditions(conditions: Column) -> Column:
    """Each condition once, in first order; key order does not tell conditions apart."""
    return F.array_distinct(F.transform(conditions, canonical_json))


def combine_conditions(conditions: Column) -> Column:
    """No condition: null.  One: itself.  Several: any of them."""
    return _any_of(conditions)


def where_predicate(tree: dict | None) -> Column | None:
    """A filter tree as a Column; an empty tree is no filter."""
    if not tree:
        return None
    parts = []
    for key, value in tree.items():
        if key in ("$and", "$or"):
            inner = [where_predicate(t) for t in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b),
                                inner))
        elif isinstance(value, dict):
            if set(value) != {"$in"}:
                raise ValueError(f"unknown condition: {value}")
            parts.append(F.col(f"`{key}`").isin(*value["$in"]))
        else:
            parts.append(F.col(f"`{key}`") == value)
    return reduce(lambda a, b: a & b, parts)


def in_scope(answer: Column) -> Column:
    """Whether a stored classifier answer lets the query through; no answer does."""
    return F.coalesce(F.contains(F.upper(F.trim(answer)), F.lit("IN_SCOPE")), F.lit(True))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def phrases(text: Column, lengths: list[int]) -> Column:
    """All runs of so many words of a text, each once."""
    def all_runs(w: Column) -> Column:
        def runs(n: int) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))),
                              lambda i: i + (n - 1) <= F.size(w))
            return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))

        return F.array_distinct(F.concat(F.array().cast("array<string>"), *[runs(n) for n in lengths]))

    return bind(words(text), all_runs)
