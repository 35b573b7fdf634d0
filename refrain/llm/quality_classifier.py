"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of word and byte n-grams, hashed into a fixed number of columns: words and pairs of words, and runs of
two and three bytes; two more say that any word follows itself, once or twice. Each indicator is scaled by its class log-count ratio, then a linear model with hinge loss is
fitted by dual coordinate descent (Hsieh et al., 2008). The margin becomes a score by a logistic function fitted on
margins of rows that the model of another fold has not seen.

The model is fitted in one task, on at most `sample` labelled rows, those with the least hash of their doc_id; so its
cost does not grow with the corpus. The driver gets the weights alone. Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.llm.common import as_bytes, batches, fresh, quoted, read, with_computed
from refrain.llm.shingles import ODD, WordHashes, mix64


@dataclass(frozen=True)
class ClassifierParams:
    """sample: labelled rows to fit on, at most. bits: log2 of the columns. threshold: score from which a row is of label 1."""

    sample: int = 4000
    bits: int = 18
    alpha: float = 1.0
    c: float = 3.0
    epochs: int = 12
    folds: int = 4
    threshold: float = 0.7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one per column
    bias: float
    slope: float
    shift: float
    bits: int

    def score(self, features: np.ndarray) -> float:
        """Probability of label 1; without features, of the bias alone."""
        margin = (float(self.weights[features].sum()) / np.sqrt(max(1, len(features)))) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def features(text: bytes, known: WordHashes, bits: int, repeats: bool = True) -> np.ndarray:
    """Distinct columns, ascending, of the n-grams of a text. repeats: with the two columns of words that follow themselves."""
    words = known.of(text.split())
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    two = raw[:-1] << np.uint64(8) | raw[1:]
    parts = [words, mix64(words[:-1] * ODD + words[1:]), two + np.uint64(1 << 40), (two[:-1] << np.uint64(8) | raw[2:]) + np.uint64(1 << 41)]
    every = np.concatenate(parts)
    columns = (every * ODD ^ every * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(29)) * ODD >> np.uint64(64 - bits)
    if 32 * len(columns) < 1 << bits:
        columns = np.unique(columns).astype(np.int32)
    else:  # long texts: a mark for each column
        hit = np.zeros(1 << bits, bool)
        hit[columns] = True
        columns = np.flatnonzero(hit).astype(np.int32)
    if not repeats:
        return columns
    columns = np.unique(np.where(columns < 2, columns + 2, columns)) if len(columns) and columns[0] < 2 else columns
    same = words[1:] == words[:-1]
    own = [i for i, found in enumerate((same.any(), (same[1:] & same[:-1]).any())) if found]  # columns of their own
    return np.concatenate([np.array(own, np.int32), columns]) if own else columns


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, p: ClassifierParams) -> np.ndarray:
    counts = np.full((2, 1 << p.bits), p.alpha)
    for row, label in zip(rows, labels, strict=True):
        counts[int(label), row] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, p: ClassifierParams) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model of the scaled indicators, by dual coordinate descent."""
    sign = np.where(labels > 0, 1.0, -1.0)
    values = [ratios[row] / np.sqrt(max(1, len(row))) for row in rows]
    norms = np.array([float(v @ v) for v in values]) + 1
    weights, bias, dual = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    most = np.where(sign > 0, 0.5 / (sign > 0).mean(), 0.5 / max((sign < 0).mean(), 1e-9)) * p.c  # either class weighs as much
    random = np.random.default_rng(0)
    for _ in range(p.epochs):
        for i in random.permutation(len(rows)):
            slope = sign[i] * (float(weights[rows[i]] @ values[i]) + bias) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), most[i])
            if step := (new - dual[i]) * sign[i]:
                weights[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic function of the margins, by Newton's method on smoothed targets (Platt, 1999)."""
    good = labels.sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, v = q - target, q * (1 - q) + 1e-9
        gradient = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        hessian = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
    return a, b


def fit(rows: list[np.ndarray], labels: np.ndarray, p: ClassifierParams = ClassifierParams()) -> Model:
    """Without rows of both classes, the score is their share of label 1 (1/2 without rows)."""
    good = float(labels.sum())
    if not len(rows) or good in (0.0, float(len(rows))):
        return Model(np.zeros(1 << p.bits, np.float32), 0.0, 1.0, float(np.log((good + 1) / (len(rows) - good + 1))), p.bits)

    def trained(at: np.ndarray) -> tuple[np.ndarray, float]:
        some = [rows[i] for i in at]
        ratios = log_count_ratios(some, labels[at], p)
        weights, bias = descend(some, labels[at], ratios, p)
        return weights * ratios, bias

    def margin(model: tuple[np.ndarray, float], row: np.ndarray) -> float:
        return float(model[0][row].sum()) / np.sqrt(max(1, len(row))) + model[1]

    fold = np.random.default_rng(1).integers(0, p.folds, len(rows))
    margins = np.zeros(len(rows))
    for k in range(p.folds):
        here = np.flatnonzero(fold == k)
        there = np.flatnonzero(fold != k)
        if len(here) and 0 < labels[there].sum() < len(there):
            model = trained(there)
            margins[here] = [margin(model, rows[i]) for i in here]
    a, b = calibrate(margins, labels)
    weights, bias = trained(np.arange(len(rows)))
    return Model(weights.astype(np.float32), bias, a, b, p.bits)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: ClassifierParams = ClassifierParams()) -> Model:
    """Model of labels (doc_id, label) for documents (doc_id, text).

    Labels that are null, neither 0 nor 1, or held out by their doc_id are not read. A document with several labels counts once
    with each. The rows of the sample, which are chosen by a hash of their doc_id, meet the documents by a broadcast, whose size `sample` bounds.
    Null and empty texts have no n-grams; without rows the model gives 1/2.
    """
    wanted = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "label").distinct()
    some = wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(p.sample).select(F.col("doc_id").alias("of"), F.col("label").cast("int"))
    texts = docs.select(F.col("doc_id").alias("of"), as_bytes("text")).join(F.broadcast(some), "of").select("of", "label", "text")
    schema, bits = pa.schema([("of", pa.int64()), ("label", pa.int32()), ("found", pa.binary())]), p.bits

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        rows = ((i, label, features(t.as_py(), known, bits).tobytes()) for b in stream for i, label, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True))
        yield from batches(rows, schema, 64)

    # rows that share a doc_id may be more than the sample; the bound holds for them too
    found = texts.mapInArrow(run, "of bigint, label int, found binary").orderBy(F.xxhash64("of"), "of", "label", "found").limit(p.sample)
    model = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("shift", pa.float64())])

    def fitted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        said: list[float] = []
        for batch in stream:
            rows += [np.frombuffer(x.as_py(), np.int32) for x in batch.column(2)]
            said += batch.column(1).to_pylist()
        if rows:
            m = fit(rows, np.array(said, float), p)
            yield from batches([(m.weights.tobytes(), m.bias, m.slope, m.shift)], model)

    got = found.mapInArrow(fitted, "weights binary, bias double, slope double, shift double").collect()
    return Model(np.frombuffer(got[0].weights, np.float32), got[0].bias, got[0].slope, got[0].shift, p.bits) if got else fit([], np.array([]), p)


def scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs, with the score of the text (a column of that name is replaced); null and empty texts have that of a document without n-grams.

    Equal texts have equal scores; texts are read whole; other columns stay, under any names; a table without rows gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scorer() -> Callable[[pa.Array], pa.Array]:
        known, judge = WordHashes(), shared.value
        return lambda texts: pa.array((judge.score(features(t.as_py(), known, judge.bits)) for t in texts), pa.float64())

    return with_computed(docs, "text", name, T.DoubleType(), scorer)


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str, p: ClassifierParams) -> Model:
    return train(docs, read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), p)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, a row each.

    Null and empty texts score as documents without n-grams; a null doc_id is not held out; repeated rows are scored each;
    other columns are never read; a table without rows gives none.
    """
    p = ClassifierParams()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = scores(docs, _model(spark, docs, sf_dir, p))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= p.threshold, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; the others go."""
    p = ClassifierParams()
    name = fresh(docs, "score")
    return scores(docs, _model(spark, docs, sf_dir, p), name).where(F.col(name) >= p.threshold).select(*quoted(docs.columns))
