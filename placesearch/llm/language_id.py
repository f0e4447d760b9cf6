"""Language identification by nearest centroid.

A text is a vector of hashed letter n-grams (one to three letters, words padded with a blank),
weighted by root term frequency times inverse document frequency and brought to length one.  Each
language is described by several centroids, found by clustering its training texts, so that its
different kinds of text need not share one mean.  The language of the nearest centroid by cosine
wins.  A text that is further from every centroid than training texts of that language ever are is
rejected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from placesearch.llm.landing import fold, held_out, map_texts, share, table, text_of, whole_rows

FEATURES = 1 << 12           # hashed n-grams
CENTROIDS = 4                # per language
SAMPLE = 2000                # different training texts clustered per language
MAX_LANGUAGES = 1000         # keeps the model under 70 MB
REJECT = 0.5                 # share of the lowest training similarity that is still accepted
LOWEST = 0.001               # which quantile of the training similarities counts as the lowest
FOLDS = 5
UNKNOWN = "und"
_CELLS = 1 << 21             # code points or matrix cells handled at once
_ROUNDS = 12
_SALTS = 64
_U = np.uint32
_folded: list[np.ndarray] = []


@dataclass
class Model:
    weights: np.ndarray      # inverse document frequency of each feature
    centroids: np.ndarray    # one row each, of length one
    owner: np.ndarray        # index into languages
    languages: list[str]
    floors: np.ndarray       # smallest accepted similarity of each language


def _letters() -> np.ndarray:
    """Lower-cased code point of each letter, 32 for everything else."""
    if not _folded:
        codes = np.full(0x110000, 32, dtype=_U)
        for c in range(0x30000):
            ch = chr(c)
            if ch.isalpha():
                codes[c] = ord(ch.lower()[0])
        _folded.append(codes)
    return _folded[0]


def _grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text, in pieces of bounded size."""
    table_ = _letters()
    for at in range(0, len(text), _CELLS):
        # pieces overlap by the two letters that a trigram looks back
        part = text[max(0, at - 2):at + _CELLS]
        code = table_[np.frombuffer(part.encode("utf-32-le", "replace"), dtype=_U)]
        keep = np.ones(len(code), dtype=bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        code = np.concatenate([[_U(32)], code[keep], [_U(32)]]).astype(_U)
        one = code * _U(2654435761)
        two = (one[:-1] ^ (one[:-1] >> _U(15))) * _U(2246822519) + code[1:]
        three = (two[:-1] ^ (two[:-1] >> _U(13))) * _U(3266489917) + code[2:]
        for grams, real in ((one, code != 32), (two, (code[1:] != 32) | (code[:-1] != 32)),
                            (three, code[1:-1] != 32)):
            h = grams[real]
            h = (h ^ (h >> _U(16))) * _U(2246822519)
            yield (h >> _U(32 - int(FEATURES).bit_length() + 1)).astype(np.int64)


def _counts(texts: list[str]) -> np.ndarray:
    found = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for i, text in enumerate(texts):
        for grams in _grams(text):
            found[i] += np.bincount(grams, minlength=FEATURES)
    return found


def _batches(column: pa.Array) -> Iterator[list[str]]:
    """Texts of one Arrow column, a bounded matrix at a time."""
    step = max(1, _CELLS // FEATURES)
    for at in range(0, len(column), step):
        yield [t or "" for t in column.slice(at, step).to_pylist()]


def _vectors(texts: list[str], weights: np.ndarray) -> np.ndarray:
    found = np.sqrt(_counts(texts)) * weights
    length = np.sqrt((found ** 2).sum(axis=1, keepdims=True))
    return found / np.maximum(length, 1e-12)


def document_frequency(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of texts with each feature; each task sends one row per feature."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(FEATURES, dtype=np.int64)
        for batch in batches:
            for part in _batches(batch.column(0)):
                total += len(part)
                seen += (_counts(part) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, FEATURES)), pa.array(np.concatenate([[total], seen]))],
            ["feature", "n"])

    rows = (map_texts(texts, count, "feature long, n long")
            .groupBy("feature").agg(F.sum("n").alias("n")).collect())
    n = np.zeros(FEATURES + 1, dtype=np.int64)
    for row in rows:
        n[row.feature + 1] = row.n
    return int(n[0]), n[1:]


def _cluster(vectors: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, the next the least similar text each."""
    centres = [vectors.mean(axis=0)]
    for _ in range(min(count, len(vectors)) - 1):
        near = np.max(vectors @ np.array([c / max(np.linalg.norm(c), 1e-12) for c in centres]).T,
                      axis=1)
        # not the very least, which may be a stray text
        centres.append(vectors[np.argsort(near, kind="stable")[len(near) // 100]])
    found = np.array(centres)
    for _ in range(_ROUNDS):
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
        nearest = np.argmax(vectors @ found.T, axis=1)
        moved = np.array([vectors[nearest == i].mean(axis=0) if (nearest == i).any() else found[i]
                          for i in range(len(found))])
        if np.allclose(moved, found):
            break
        found = moved
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def _sample(rows: DataFrame, sample: int) -> DataFrame:
    """``lang, text``: of each language ``sample`` different texts, or all if it has fewer.

    Texts are told apart and drawn by their hash.  Each is taken once, and copies only make it
    likelier to be taken, so they neither crowd out other texts nor add rows.  Only hashes are
    shuffled until the few texts are chosen.
    """
    hashed = rows.withColumn("h", F.xxhash64("text"))
    # a text's turn comes after a time that is shorter the more copies it has
    draw = (F.pmod("h", F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    near = hashed.groupBy("lang", "h").agg((-F.log(draw) / F.count("*")).alias("turn"))
    for keys in (["lang", F.pmod(F.xxhash64("h"), F.lit(_SALTS))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("turn", "h"))
        near = near.withColumn("_place", place).filter(F.col("_place") <= sample).drop("_place")
    chosen = F.broadcast(near.drop("turn"))       # at most ``sample`` hashes of a language
    return hashed.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).drop("h")


def train(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Fit on ``text, lang, doc_id``: frequencies over all rows, centroids on a bounded sample.

    The sample has ``sample`` different texts of each language, each once, see ``_sample``.  Rows
    without text, letters or language are not used.
    """
    rows = labelled.select("text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if rows.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    total, seen = document_frequency(rows.select("text"))
    weights = np.log((1 + total) / (1 + seen)).astype(np.float32) + np.float32(0.05)

    def describe(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.concatenate([_vectors(list(frame["text"][at:at + 256]), weights)
                                  for at in range(0, len(frame), 256)])
        centres = _cluster(vectors, centroids)
        near = (vectors @ centres.T).max(axis=1)
        return pd.DataFrame({"lang": key[0], "centre": [c.astype(np.float32).tobytes()
                                                        for c in centres],
                             "floor": float(np.quantile(near, LOWEST)) * REJECT})

    found = (_sample(rows, sample).groupBy("lang")
             .applyInPandas(describe, "lang string, centre binary, floor double").collect())
    found = sorted(found, key=lambda r: (r.lang, bytes(r.centre)))
    languages = sorted({r.lang for r in found})
    place = {lang: i for i, lang in enumerate(languages)}
    floors = np.zeros(len(languages))
    for r in found:
        floors[place[r.lang]] = r.floor
    centres = (np.array([np.frombuffer(r.centre, dtype=np.float32) for r in found])
               if found else np.zeros((0, FEATURES), dtype=np.float32))
    return Model(weights, centres, np.array([place[r.lang] for r in found], dtype=np.int64),
                 languages, floors)


def predict(docs: DataFrame, model: Model, row_key: str = "doc_id") -> DataFrame:
    """``row_key, lang_pred, score, rejected`` of each row, from its whole text alone.

    ``und`` and score 0 without text or letters, or when nothing could be learned; such rows are
    rejected, and so are texts too far from every centroid.  Equal similarities go to the first
    language in sorted order.
    """
    shared = share(docs.sparkSession, model)
    kind = docs.schema[row_key].dataType
    rows = docs.select(F.col(row_key).alias("_id"), text_of().alias("_text"),
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            langs, scores, rejected = [], [], []
            for part in _batches(batch.column(1)):
                if len(m.owner):
                    near = _vectors(part, m.weights) @ m.centroids.T
                    best = near.argmax(axis=1)
                    score = np.clip(near[np.arange(len(part)), best], 0, 1).astype(float)
                    lang = m.owner[best]
                    bad = score < m.floors[lang]
                else:
                    lang, score = np.full(len(part), -1), np.zeros(len(part))
                    bad = np.ones(len(part), dtype=bool)
                langs.append(lang)
                scores.append(score)
                rejected.append(bad)
            if not langs:
                continue
            has = np.array(batch.column(2).to_pylist(), dtype=bool)
            lang = np.where(has, np.concatenate(langs), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[lang], pa.string()),
                 pa.array(np.where(has & (lang >= 0), np.concatenate(scores), 0.0)),
                 pa.array(np.concatenate(rejected) | (lang < 0))],
                ["_id", "lang_pred", "score", "rejected"])

    out = map_texts(rows, judge, f"_id {kind.simpleString()}, lang_pred string, score double, "
                                 "rejected boolean")
    return out.withColumnRenamed("_id", row_key)


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: a language is given and the fold is not 0."""
    return docs.filter(fold(FOLDS) != 0).select("doc_id", "text", "lang")


def keep_identified(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """The documents whose language is not rejected, with all their columns; no shuffle of texts."""
    model = train(learnable(docs if learn_from is None else learn_from))
    judged = predict(whole_rows(docs, text=F.col("text")), model, "row")
    return judged.filter(~F.col("rejected")).select("row.*")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(learnable(docs)))
    return found.select("doc_id", held_out(FOLDS).alias("held_out"), "lang_pred", "score",
                        "rejected")


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
