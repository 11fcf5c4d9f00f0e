"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all training rows. The classifier itself is fitted on at most ``sample`` different training
rows (the ones whose hash is smallest) with follow-the-regularised-leader and elastic-net penalties, and a temperature is
fitted on a part of them that training left out. Every row is then scored over its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDECIDED = "und"


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; numerals such as one half or superscripts are none."""
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LangParams:
    """orders: n-gram lengths. bits: log2 of the hashed features. sample: most rows that the classifier is fitted on.
    l1, l2: elastic net. alpha, beta: step sizes. rounds: passes over the sample."""

    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    sample: int = 2500
    l1: float = 0.0005
    l2: float = 0.01
    alpha: float = 1.0
    beta: float = 1.0
    rounds: int = 3


_SPACE = re.compile(r"(?<=[^\x00-\x20])[\x00-\x20]")  # the first of a run


def features(text: str, orders: tuple[int, ...], bits: int, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the whole lower-cased text, taken about ``size`` characters at a time: distinct features and their
    counts. No n-gram crosses white space runs other than as one space."""
    counts, tail, at = np.zeros(1 << bits, np.int64), np.zeros(0, np.uint32), 0
    while at < len(text) or not at:
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        piece = (" " if not at else "") + text[at:end].lower() + (" " if end == len(text) else "")
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(points <= 32, np.uint32(32), points)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        points = np.concatenate([tail, points[keep]])
        h = np.zeros(len(points), np.uint32)
        for n in range(1, max(orders) + 1):
            if n > len(points):
                break
            h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in orders:
                new = h[max(0, len(tail) - n + 1) :]  # those that end in this piece
                counts += np.bincount((new ^ (new >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits), minlength=1 << bits)
        tail, at = points[max(0, len(points) - max(orders) + 1) :], max(end, 1)
    found = np.flatnonzero(counts)
    return found, counts[found]


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(counts)) * idf[at]
    return value / max(np.sqrt(value @ value), 1e-12)


@dataclass
class Classifier:
    """Languages, weights (features x languages), intercepts and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    intercepts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.intercepts


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, params: LangParams) -> Classifier:
    """FTRL-proximal over (lang, features, counts) rows; the last fifth only sets the temperature."""
    langs = sorted({lang for lang, _, _ in rows})
    model = Classifier(langs, idf)
    data = [(langs.index(lang), at, weighted(at, counts, idf)) for lang, at, counts in rows]
    held = data[len(data) - len(data) // 5 :] or data
    train = data[: len(data) - len(data) // 5] or data
    z, n = (np.zeros((len(idf) + 1, len(langs))) for _ in range(2))
    l1, l2, alpha, beta = params.l1, params.l2, params.alpha, params.beta

    def proximal(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(params.rounds):
        for label, at, value in train:
            at, value = np.append(at, len(idf)), np.append(value, 1.0)
            zs, ns = z[at], n[at]
            w = proximal(zs, ns)
            error = softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    w = proximal(z, n)
    model.weights, model.intercepts = w[:-1], w[-1]
    logits = np.array([model.logits(at, value) for _, at, value in held])
    labels = np.array([label for label, _, _ in held])
    losses = {t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in np.geomspace(0.05, 20, 121)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def train(docs: DataFrame, training: Column, params: LangParams = LangParams()) -> Classifier | None:
    """A classifier of the training rows that have a language; None if there are none."""
    spark, size = docs.sparkSession, 1 << params.bits
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[features(text, params.orders, params.bits)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at])], names=["feature", "n"])

    n = rows.count()
    if not n:
        return None
    found = rows.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()  # 2**bits rows at most
    df = np.zeros(size, np.int64)
    df[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    idf = np.log((1 + n) / (1 + df)) + 1

    # rows are sampled by what they hold, so that one id on very many rows takes no more room than others; repeats count once
    hashed = rows.withColumn("_by", F.xxhash64("doc_id", "lang", "text", F.lit(3)))
    chosen = spark.createDataFrame(hashed.select("_by").distinct().orderBy("_by").limit(params.sample).collect(), "_by long")

    def extracted(batches):
        for batch in batches:
            found = [features(t, params.orders, params.bits) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], names=["by", "lang", "at", "counts"])

    kept = hashed.join(F.broadcast(chosen), "_by").dropDuplicates(["_by"]).select(F.col("_by").alias("by"), "lang", "text")
    got = kept.mapInArrow(extracted, "by long, lang string, at binary, counts binary").collect()
    got.sort(key=lambda r: (r["by"], r["lang"], r["at"], r["counts"]))
    data = [(r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["counts"], "<i4")) for r in got]
    return fit(data, idf, params)


def predict(docs: DataFrame, model: Classifier | None, params: LangParams = LangParams(), carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score (the calibrated probability, 0 to 1) of every row, then the ``carry`` columns.

    A null text or one without a letter is ``und`` with score 0, as is every row if nothing could be learned. Only the
    text is looked at; ties go to the language that sorts first.
    """
    carry = carry or []
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                lang, score = UNDECIDED, 0.0
                if known and text and has_letter(text):
                    at, counts = features(text, params.orders, params.bits)
                    p = softmax(known.logits(at, weighted(at, counts, known.idf)) / known.temperature)
                    lang, score = known.langs[int(p.argmax())], float(p.max())
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], names=["doc_id", "lang_pred", "score", *carry])

    schema = ", ".join(["doc_id long, lang_pred string, score double", *(f"`{c}` {types[c]}" for c in carry)])
    return docs.select(F.col("doc_id").cast("long"), "text", *carry).mapInArrow(run, schema)
