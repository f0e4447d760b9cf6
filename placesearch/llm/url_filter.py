"""URL filter: rules first, then the ratio of two character language models.

Urls that a rule decides are the examples.  Accepted and rejected ones each train a smoothed Markov
model of variable order: the chance of a character mixes the counts after the longest context seen
with those after ever shorter ones.  Of a url without a rule, the difference of the two
log-likelihoods per character decides, at a threshold calibrated on examples that the models were
not trained on.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm import words
from placesearch.llm.landing import fold, share, table

# Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER = 4                 # longest context
SMOOTH = 4.0              # weight of the next shorter context, in characters
BUCKETS = 1 << 16         # per order and class; hashed, so the models stay under 11 MB
PARTS = 3                 # of the examples, for calibration
_BIN = 0.01
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _END = b"\x02" * ORDER, b"\x03"
_U = np.uint64


@dataclass
class Model:
    grams: np.ndarray         # counts by class, order and bucket
    contexts: np.ndarray
    slope: float = 1.0        # log odds of acceptance by difference per character
    offset: float = 0.0


def _after_scheme() -> Column:
    at = F.locate("://", F.col("url"))
    return F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.lit(""))


def host_and_path(pages: DataFrame) -> DataFrame:
    """``page_id, host, path``; both are empty for a url that is null or has no ``://``."""
    rest = F.coalesce(_after_scheme(), F.lit(""))
    cut = pages.select("page_id", rest.alias("_rest")).withColumn(
        "_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    behind = F.substring(F.col("_rest"), F.length("_host") + 1, F.length("_rest"))
    return cut.select("page_id", F.translate("_host", _UPPER, _LOWER).alias("host"),
                      F.regexp_extract(behind, "^[^?#]*", 0).alias("path"))


def _by_rule(rules: tuple, wanted: int) -> Column:
    """Field ``wanted`` of the longest rule that fits; of equally long ones, that with more host."""
    found = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = (((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}")))
                & F.startswith(F.col("path"), F.lit(path)))
        found = F.when(fits, F.lit((verdict, host + path)[wanted])).otherwise(found)
    return found


def judged_by_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``page_id, host, path, rule, ruled``: the rule's text and its verdict, or nulls."""
    return host_and_path(pages).withColumns({"rule": _by_rule(rules, 1), "ruled": _by_rule(rules, 0)})


def _symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All urls' bytes with start and end marks, digits alike; the url of each byte to be told."""
    texts = [(t or "").encode() for t in column.to_pylist()]
    data = np.frombuffer(b"".join(_START + t + _END for t in texts), dtype=np.uint8).copy()
    data[(data >= 48) & (data <= 57)] = 48
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + ORDER + 1)
    first = np.concatenate([[0], np.cumsum(sizes + ORDER + 1)[:-1]]) if len(texts) else np.zeros(0, int)
    told = np.ones(len(data), dtype=bool)
    for j in range(ORDER):
        told[first + j] = False
    return data, np.where(told, owner, -1)


def _buckets(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: the buckets of the context of each place and of the context with its character."""
    wide = data.astype(_U)
    context = np.zeros(len(at), dtype=_U)
    for order in range(ORDER + 1):
        if order:
            context = words.mix(context * _U(257) + wide[at - order] + _U(1))
        whole = words.mix(context * _U(0x9E3779B97F4A7C15) + wide[at] + _U(7))
        mask = _U(BUCKETS - 1)
        yield order, (context & mask).astype(np.int64), (whole & mask).astype(np.int64)


def _text() -> Column:
    return F.concat("host", "path")


def count(examples: DataFrame) -> Model:
    """Train on ``host, path, accepted``; tasks send their summed counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2, ORDER + 1, BUCKETS), dtype=np.int64)
        for batch in batches:
            data, owner = _symbols(batch.column(0))
            at = np.flatnonzero(owner >= 0)
            side = np.array(batch.column(1).to_pylist(), dtype=np.int64)[owner[at]]
            for order, context, whole in _buckets(data, at):
                for c in (0, 1):
                    own = side == c
                    total[0, c, order] += np.bincount(whole[own], minlength=BUCKETS)
                    total[1, c, order] += np.bincount(context[own], minlength=BUCKETS)
        cells = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])],
                                         ["cell", "n"])

    rows = (examples.select(_text(), F.col("accepted").cast("int"))
            .mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas())
    total = np.zeros(2 * 2 * (ORDER + 1) * BUCKETS)
    total[rows["cell"].to_numpy(np.int64)] = rows["n"]
    total = total.reshape(2, 2, ORDER + 1, BUCKETS)
    return Model(total[0], total[1])


def _log_chances(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-likelihood of each character under the rejected (0) and the accepted (1) model."""
    chance = np.full((2, len(at)), 1 / 256)
    for order, context, whole in _buckets(data, at):
        for c in (0, 1):
            seen, n = model.grams[c, order][whole], model.contexts[c, order][context]
            # buckets are shared by hashing, so a context may seem rarer than what follows it
            chance[c] = (seen + SMOOTH * chance[c]) / (np.maximum(n, seen) + SMOOTH)
    return np.log(chance)


def with_difference(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``difference``: log-likelihood ratio per character, the end counted as one."""
    shared = share(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(shared.value)
        for batch in batches:
            data, owner = _symbols(batch.column(0))
            at = np.flatnonzero(owner >= 0)
            logs = _log_chances(model, data, at)
            found = np.bincount(owner[at], weights=logs[1] - logs[0], minlength=batch.num_rows)
            sizes = np.maximum(np.bincount(owner[at], minlength=batch.num_rows), 1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found / sizes)],
                                             ["row", "difference"])

    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    packed = rows.select(_text().alias("text"), whole)
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, difference double"
                             ).select("row.*", "difference")


def _cells(examples: DataFrame, model: Model) -> pd.DataFrame:
    """Examples counted per cell of ``_BIN`` of their difference, a table of bounded size."""
    cell = F.round(F.col("difference") / _BIN).cast("int").alias("cell")
    return with_difference(examples, model).groupBy(cell, "accepted").agg(F.count("*").alias("n")).toPandas()


def calibrate(rows: pd.DataFrame) -> tuple[float, float]:
    """Slope and offset of the odds of acceptance by difference.

    ``rows``: ``cell, accepted, n``.  Both classes weigh the same in total.
    """
    x = rows["cell"].to_numpy(float) * _BIN
    y, n = rows["accepted"].to_numpy(bool), rows["n"].to_numpy(float)
    if not len(rows) or y.all() or not y.any():
        return 1.0, 0.0
    weight = np.where(y, n / n[y].sum(), n / n[~y].sum())
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        # a weak pull to slope 1 keeps separable examples finite
        grad = design.T @ (weight * (p - y)) + 1e-3 * (theta - [1.0, 0.0])
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, grad)
        theta -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def train(examples: DataFrame) -> Model:
    """``page_id, host, path, accepted``: all train the models.

    For calibration each part of the examples is judged by models trained on the other parts.
    """
    part = F.coalesce(fold(PARTS, "page_id"), F.lit(0))
    told = pd.concat([_cells(examples.filter(part == p), count(examples.filter(part != p)))
                      for p in range(PARTS)])
    model = count(examples)
    return Model(model.grams, model.contexts, *calibrate(told))


def filter_urls(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, probability, difference``.

    A null url, or one without ``://``, has empty parts and is judged like any other by the models,
    from its end alone.  Without accepted or rejected examples both models are alike, and what no
    rule decides is allowed.  Rows that repeat are judged each.  Only ``page_id`` and ``url`` are read.
    """
    ruled = judged_by_rules(pages, rules)
    examples = ruled.filter("ruled IS NOT NULL").withColumn("accepted", F.col("ruled") == "allow")
    model = train(examples)
    told = with_difference(ruled, model)
    odds = F.col("difference") * model.slope + model.offset
    own = F.when(odds >= 0, F.lit("allow")).otherwise(F.lit("block"))
    return told.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"),
                       (1 / (1 + F.exp(-odds))).alias("probability"), "difference")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op9_url_filter": op9_url_filter}
SQL: dict[str, str] = {}
