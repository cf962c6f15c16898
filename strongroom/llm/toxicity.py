"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text's features say which hashed n-grams of 3 to 5 characters it holds (lower case, runs of white
space as one space, a space at either end).  A feature's value is the log ratio of its smoothed
frequencies in toxic and other examples; logistic regression weighs these values.  The examples are a
bounded sample: up to ``fit_rows`` labelled documents of each class, those whose hashed ids
are least.  Class weights restore the rates of all labelled rows.  How great an n-gram's chi-squared has to be to count, and the penalty, are those
of GRID with the fewest wrong decisions over folds of the examples; no other row has a part in the choice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm._common import checkpoint, code_points, fresh_name, whole_text
from strongroom.llm._minimise import minimise

#: Hash buckets of n-grams.
BITS = 18
#: Labelled documents of each class that the model is fitted on, at most.
FIT_ROWS = 2_000
#: What is tried: the least chi-squared of an n-gram that counts, and the penalty of weights; over so many folds of the examples.
GRID, FOLDS = [(chi, penalty) for chi in (8.0, 16.0, 32.0) for penalty in (1e-3, 1e-4)], 3
THRESHOLD = 0.7
_STEP = 1 << 20


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of the whole text, repeats included, in pieces."""
    points = code_points(f" {' '.join(text.lower().split())} ")
    for k in range(0, max(1, len(points) - 2), _STEP):
        c = points[k : k + _STEP + 4].astype(np.uint64)
        h = c[: max(0, len(c) - 1)] * np.uint64(0x100000001B3) + c[1:]
        for n in (3, 4, 5):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]
            yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """slot: the place of a bucket among the kept features or the last, unused place; weights: of the places."""

    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        seen = np.zeros(len(self.weights), bool)
        for buckets in gram_buckets(text):
            seen[self.slot[buckets]] = True
        return float(1 / (1 + np.exp(-np.clip(self.weights[np.flatnonzero(seen)].sum() + self.bias, -40, 40))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold a bucket, over a task's rows."""
    found = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen = np.zeros(1 << BITS, bool)
            for buckets in gram_buckets(text):
                seen[buckets] = True
            found[label] += seen
    at = np.flatnonzero(found.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[0, at]), pa.array(found[1, at])], ["bucket", "clean", "toxic"])


def _held(slot: np.ndarray, kept: int):
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                seen = np.zeros(kept + 1, bool)
                for buckets in gram_buckets(text):
                    seen[slot[buckets]] = True
                rows.append(np.flatnonzero(seen[:kept]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "label", "features"])

    return held


def _prior(toxic: float, clean: float, buckets: int = 1 << BITS) -> Model:
    return Model(np.zeros(buckets, np.int32), np.zeros(1), float(np.log((toxic + 1) / (clean + 1))))


@dataclass(frozen=True)
class Examples:
    """Labelled texts as places of their features: entry e says that text row[e] holds feature column[e]."""

    row: np.ndarray
    column: np.ndarray
    label: np.ndarray
    share: np.ndarray
    width: int

    def only(self, rows: np.ndarray) -> Examples:
        number = np.full(len(self.label), -1, np.int32)
        number[rows] = np.arange(len(rows), dtype=np.int32)
        kept = number[self.row] >= 0
        return Examples(number[self.row[kept]], self.column[kept], self.label[rows], self.share[rows] / self.share[rows].sum(), self.width)

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """How many toxic and how many clean texts hold each feature."""
        toxic = self.label[self.row]
        return np.bincount(self.column, weights=toxic, minlength=self.width), np.bincount(self.column, weights=1 - toxic, minlength=self.width)

    def margin(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.row, weights=weights[self.column], minlength=len(self.label)) + bias

    def loss(self, margin: np.ndarray) -> float:
        return float(self.share @ (np.logaddexp(0, margin) - self.label * margin))


def log_ratio(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """The naive Bayes log-count ratio of each feature, by add-one frequencies."""
    return np.log((toxic + 1) / (toxic + 1).sum()) - np.log((clean + 1) / (clean + 1).sum())


def chi_squared(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Of holding a feature and being toxic; 0 for a feature of one text."""
    held, n = toxic + clean, n_toxic + n_clean
    chi = (toxic * (n_clean - clean) - clean * (n_toxic - toxic)) ** 2 * n / (n_toxic * n_clean * held * (n - held) + 1e-9)
    return np.where(held >= 2, chi, 0.0)


def learn(examples: Examples, ratio: np.ndarray, least_chi: float, penalty: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights of the features (0 where chi-squared is less) and the bias, by penalised logistic regression on ratio times presence."""
    toxic, clean = examples.held()
    kept = chi_squared(toxic, clean, int(examples.label.sum()), int((1 - examples.label).sum())) >= least_chi
    place = (np.cumsum(kept) - 1).astype(np.int32)
    inside = kept[examples.column]
    row, column, own = examples.row[inside], place[examples.column[inside]], ratio[kept]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        margin = np.bincount(row, weights=(x[:-1] * own)[column], minlength=len(examples.label)) + x[-1]
        off = examples.share * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - examples.label)
        grad = np.bincount(column, weights=off[row], minlength=len(own)) * own + penalty * x[:-1]
        return examples.loss(margin) + penalty / 2 * x[:-1] @ x[:-1], np.append(grad, off.sum())

    rate = np.clip(examples.share @ examples.label, 1e-6, 1 - 1e-6)
    x = minimise(loss, np.append(np.zeros(len(own)), np.log(rate / (1 - rate))), steps=steps)
    weights = np.zeros(examples.width)
    weights[kept] = x[:-1] * own
    return weights, float(x[-1])


def choose(examples: Examples, grid: list[tuple[float, float]] = GRID, folds: int = FOLDS, threshold: float = THRESHOLD) -> tuple[float, float]:
    """The entry of the grid with the fewest wrong decisions at the threshold on examples that it was not fitted on, then the least loss.

    The first one where a fold lacks a class.
    """
    fold = np.arange(len(examples.label)) % folds
    wrong, loss = np.zeros(len(grid)), np.zeros(len(grid))
    for k in range(folds):
        fitted, rest = examples.only(np.flatnonzero(fold != k)), examples.only(np.flatnonzero(fold == k))
        if len(set(fitted.label)) < 2 or not len(rest.label):
            return grid[0]
        own = log_ratio(*fitted.held())
        for at, (chi, penalty) in enumerate(grid):
            margin = rest.margin(*learn(fitted, own, chi, penalty, 20))
            wrong[at] += rest.share @ ((margin >= np.log(threshold / (1 - threshold))) != rest.label)
            loss[at] += rest.loss(margin)
    return grid[int(np.lexsort((loss, np.round(wrong, 9)))[0])]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, grid: list[tuple[float, float]] = GRID) -> Model:
    """Learn from ``labels(doc_id, toxic)`` and ``docs(doc_id, text)``.

    Rows without doc_id or with a label other than 0 and 1 don't count; a document labelled both ways is
    toxic.  Without examples of both classes the score is the same for every text, from the labels'
    smoothed rate.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rates = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = rates.get(1, 0), rates.get(0, 0)
    if not toxic or not clean:
        return _prior(toxic, clean)
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(fit_rows).unionByName(known.where("label = 1").orderBy(*order).limit(fit_rows))
    # At most 2 * fit_rows ids are broadcast.
    examples = checkpoint(docs.select("doc_id", whole_text(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label"))
    counts = examples.select("text", "label").mapInArrow(_counts, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    sizes = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1) or counts.empty:
        return _prior(toxic, clean)
    counts = counts.sort_values("bucket")
    a, b = counts["toxic"].to_numpy(float), counts["clean"].to_numpy(float)
    best = np.flatnonzero(chi_squared(a, b, sizes[1], sizes[0]) >= min(chi for chi, _ in grid))
    slot = np.full(1 << BITS, len(best), np.int32)
    slot[counts["bucket"].to_numpy()[best]] = np.arange(len(best), dtype=np.int32)
    table = examples.mapInArrow(_held(slot, len(best)), "doc_id bigint, label int, features array<int>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    features = table.column("features").combine_chunks()
    lengths = features.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    label = table.column("label").to_numpy().astype(float)
    share = np.where(label == 1, toxic / sizes[1], clean / sizes[0])
    all_examples = Examples(np.repeat(np.arange(len(label), dtype=np.int32), lengths), features.flatten().to_numpy(), label, share / share.sum(), len(best))
    ratio = log_ratio(a, b)[best]
    del table, features, counts
    weights, bias = learn(all_examples, ratio, *choose(all_examples, grid))
    return Model(slot, np.append(weights, 0.0), bias)


def score_column(model: Model):
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def held_out_labels(labels: DataFrame, divisor: int, remainder: int) -> DataFrame:
    """Without the labels whose document's crc32 leaves the remainder."""
    return labels.where(crc_of("doc_id", divisor) != remainder)


def crc_of(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of each row; null or empty texts get the model's bias, repeated rows the same score.

    Texts of any length are read whole; an empty table gives an empty result; a score that equals the threshold counts as toxic; other columns are ignored.
    """
    scored = docs.select("doc_id", score_column(model)(whole_text(F.col("text"))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs whose score is below the threshold, with the columns of docs."""
    name = fresh_name(docs, "score")
    model = fit(docs, labels, **options)
    return docs.withColumn(name, score_column(model)(whole_text(F.col("text")))).where(F.col(name) < threshold).drop(name)
