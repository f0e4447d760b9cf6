"""Text quality by positive-unlabelled learning.

Only texts marked good are trusted as labelled; all other web text is an unlabelled mixture of good
and bad.  A logistic model is fitted by the non-negative unbiased risk: the risk of calling good
texts bad is subtracted from the risk of calling the mixture bad, in the share that good texts have
in it, and the difference is kept from going below zero.  That share, the class prior, is estimated
from the scores of a first model: it is the smallest ratio of mixture to good texts above any score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placesearch.llm import words
from placesearch.llm.landing import fold, held_out, map_texts, share, table

POSITIVES = 10_000        # trusted texts fitted on, in expectation
UNLABELLED = 20_000       # unlabelled texts fitted on, in expectation
CUT = 0.3                 # fixed value: score from which a text counts as good
FOLDS = 5
STEPS = 400
BATCH = 1024
RATE = 0.02
DECAY = 1e-4
_KINDS = 6
_BYTES = 128              # single bytes counted; all others share one count
FEATURES = _BYTES + 1 + 2 * _KINDS + 12 + 24


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float


def _kind_table() -> np.ndarray:
    """Per byte: capital, small or other letter, digit, sentence sign, other sign, blank (-1)."""
    kind = np.full(256, 4, dtype=np.int64)
    kind[48:58] = 2
    kind[65:91] = 0
    kind[97:123] = 1
    kind[128:] = 1
    kind[[ord(c) for c in ".,;:'\"-()"]] = 3
    kind[[32, 9, 10, 11, 12, 13]] = 5
    return kind


_KIND = _kind_table()


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def _describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    texts = len(offsets) - 1
    found = np.zeros((texts, FEATURES), dtype=np.float32)
    kind = _KIND[data]
    starts, ends, first = words.spans(data, offsets)
    hashed = words.hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    again = np.zeros(len(starts))
    again[1:] = hashed[1:] == hashed[:-1]
    # a word in capitals has three or more, and no small letter before its signs
    capitals, small = (_sums(kind == k, np.append(starts, len(data))) for k in (0, 1))
    shouted = (capitals >= 3) & (small == 0)
    signs = _sums(kind == 4, np.append(starts, len(data))) > 0
    bare = _sums((kind == 0) | (kind == 1), np.append(starts, len(data))) == 0
    # lines of all texts; a text's end ends its line
    breaks = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    line_text = np.searchsorted(offsets, breaks[:-1], side="right") - 1
    line_words = np.searchsorted(starts, breaks)
    for i in range(texts):
        lo, hi = offsets[i], offsets[i + 1]
        row = found[i]
        if lo == hi:
            continue
        part = data[lo:hi]
        counted = np.bincount(np.minimum(part, _BYTES), minlength=_BYTES + 1)[:_BYTES + 1]
        row[:_BYTES + 1] = np.sqrt(counted / (hi - lo))
        kinds = _shares(np.bincount(kind[lo:hi], minlength=_KINDS).astype(float))
        at = _BYTES + 1
        row[at:at + _KINDS] = kinds
        row[at + _KINDS:at + 2 * _KINDS] = np.sqrt(kinds)
        at += 2 * _KINDS
        a, b = first[i], first[i + 1]
        n = max(1, b - a)
        distinct = len(np.unique(hashed[a:b]))
        own = slice(a, b)
        row[at:at + 12] = (
            np.log1p(n), np.log1p(hi - lo), distinct / n, np.sqrt(distinct) / np.sqrt(n),
            again[own].sum() / n, np.sqrt(again[own].sum() / n), shouted[own].sum() / n,
            np.sqrt(shouted[own].sum() / n), signs[own].sum() / n, np.sqrt(signs[own].sum() / n),
            bare[own].sum() / n, length[own].sum() / n / 10)
    # per line, the worst line of a text counts
    at = _BYTES + 1 + 2 * _KINDS + 12
    sizes = np.diff(line_words)
    real = sizes >= 3
    if real.any():
        n = np.maximum(sizes, 1)
        rates = np.stack([_sums(x.astype(float), line_words) / n
                          for x in (again, shouted, signs, bare)], axis=1)
        mean_length = _sums(length, line_words) / n / 10
        cells = np.concatenate([rates, np.sqrt(rates), rates * np.minimum(n, 50)[:, None] / 50,
                                mean_length[:, None], (1 / np.maximum(mean_length, .1))[:, None] / 10],
                               axis=1)[real]
        owner = line_text[real]
        top = np.zeros((texts, cells.shape[1]))
        np.maximum.at(top, owner, cells)
        found[:, at:at + cells.shape[1]] = top
        # share of a text's words in lines that are mostly of one odd kind
        odd = (rates > 0.4)
        weight = np.zeros((texts, 4))
        np.add.at(weight, line_text, odd * sizes[:, None])
        share = weight / np.maximum(np.diff(first), 1)[:, None]
        found[:, at + cells.shape[1]:at + cells.shape[1] + 4] = share
        found[:, at + cells.shape[1] + 4:at + cells.shape[1] + 8] = share > 0.02
    return found


def _features(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in words.chunks(column):
        yield _describe(data, offsets)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, features``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for part in _features(batch.column(1)) for r in part]
            flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.float32)
            cut = np.arange(len(rows) + 1, dtype=np.int32) * FEATURES
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))],
                ["doc_id", "features"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "doc_id long, features array<float>")


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(good: np.ndarray, mixed: np.ndarray, prior: float, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over mini-batches."""
    draw = np.random.default_rng(seed)
    theta = np.zeros(good.shape[1] + 1)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        p = good[draw.integers(0, len(good), BATCH)]
        u = mixed[draw.integers(0, len(mixed), 2 * BATCH)]
        zp, zu = p @ theta[:-1] + theta[-1], u @ theta[:-1] + theta[-1]
        bad = _loss(-zu).mean() - prior * _loss(-zp).mean()
        # derivative by z of the loss of calling a text bad, and good
        as_bad_u, as_bad_p, as_good_p = _sigmoid(zu), _sigmoid(zp), _sigmoid(zp) - 1
        sign = 1.0
        if bad < 0:
            # the part that fell below zero is brought back instead
            sign, gp = -1.0, prior * as_bad_p
        else:
            gp = prior * as_good_p - prior * as_bad_p
        gu = sign * as_bad_u
        grad = np.append(p.T @ gp / len(p) + u.T @ gu / len(u), gp.mean() + gu.mean())
        grad[:-1] += DECAY * theta[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad ** 2
        theta -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def class_prior(good: np.ndarray, mixed: np.ndarray) -> float:
    """Share of good texts in the mixture, from scores of texts the model was not fitted on."""
    marks = np.quantile(good, np.linspace(0.02, 0.98, 49))
    p = np.array([(good >= t).mean() for t in marks])
    u = np.array([(mixed >= t).mean() for t in marks])
    slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(good)) + 1 / np.sqrt(len(mixed)))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.99))


def _rate(rows: int, wanted: int) -> float:
    return min(1.0, wanted / max(rows, 1))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample; ``docs`` and ``labels`` hold only rows that may be learned from.

    A text is trusted when all its labels say 1.  Everything may be drawn as unlabelled.  Rows are
    drawn by a hash of their id.  None when there is no trusted or no unlabelled text.
    """
    marks = (labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg((F.min("quality") == 1).alias("good")).filter("good"))
    trusted, rows = marks.count(), docs.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    as_good, as_mixed = _rate(trusted, POSITIVES), _rate(rows, UNLABELLED)
    drawn = docs.filter(F.coalesce(draw, F.lit(0.0)) < max(as_good, as_mixed)).select(
        "doc_id", "text", F.coalesce(draw, F.lit(0.0)).alias("draw"))
    # the features are much smaller than the texts, so they are what is joined
    described = features(drawn).withColumn("draw", F.coalesce(draw, F.lit(0.0)))
    sample = described.join(marks, "doc_id", "left").select(
        "features", ((F.col("draw") < as_good) & F.col("good").isNotNull()).alias("good"),
        (F.col("draw") < as_mixed).alias("mixed"), "doc_id").filter("good OR mixed").toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    x = np.array(sample["features"].tolist(), dtype=np.float64).reshape(-1, FEATURES)
    good, mixed = sample["good"].to_numpy(bool), sample["mixed"].to_numpy(bool)
    if not good.any() or not mixed.any():
        return None
    mean, scale = x[mixed].mean(axis=0), x[mixed].std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    odd = np.arange(len(x)) % 2 == 1
    even = ~odd
    prior = 0.5
    if all((good & h).any() and (mixed & h).any() for h in (odd, even)):
        estimates = []
        for a, b in ((odd, even), (even, odd)):
            w, c = fit(x[good & a], x[mixed & a], 0.5)
            estimates.append(class_prior(x[good & b] @ w + c, x[mixed & b] @ w + c))
        prior = float(np.mean(estimates))
    weights, bias = fit(x[good], x[mixed], prior)
    return Model(mean, scale, weights, bias, prior)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts are scored like any other.

    Without a model every score is 0.5.
    """
    shared = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        for batch in batches:
            found = [np.full(len(x), 0.5) if m is None else _sigmoid(
                np.clip((x - m.mean) / m.scale, -8, 8) @ m.weights + m.bias)
                for x in _features(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))],
                ["doc_id", "score"])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "doc_id long, score double")


def learnable(rows: DataFrame) -> DataFrame:
    return rows.filter(fold(FOLDS) != 0)


def predicted(column: str = "score") -> Column:
    return (F.col(column) >= CUT).cast("int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs, train(learnable(docs), learnable(labels)))
    return found.select("doc_id", held_out(FOLDS).alias("held_out"), "score",
                        predicted().alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
SQL: dict[str, str] = {}
