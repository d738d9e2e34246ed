"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import materialize, order_hash, ship

ORDERS = (4, 5, 6)
BITS = 20
#: Bound of the training sample: so many labelled texts of each class at most. Features have no bound but that of their hash, 2^20.
MAX_ROWS_PER_CLASS = 2_000
EPOCHS = 6
RATE = 0.5
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def grams(text: str | None) -> Iterator[np.ndarray]:
    """For each order the hashed character n-grams (of UTF-8 bytes, A-Z folded, a blank at either end) of the whole text, in text order."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "surrogatepass").translate(_LOWER) + b" ", np.uint8).astype(np.uint32)
    for n in ORDERS:
        if len(raw) < n:
            continue
        h = np.full(len(raw) - n + 1, n, np.uint32)
        for j in range(n):
            h *= np.uint32(0x01000193)
            h ^= raw[j : len(raw) - n + 1 + j]
        h *= np.uint32(0x9E3779B1)
        yield h >> np.uint32(32 - BITS)


def features(text: str | None) -> np.ndarray:
    """The distinct hashed n-grams of the text."""
    found = list(grams(text))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Model:
    """For each hash ``ratio``, its log-count ratio, which scales it, and ``weight``, the linear weight of the scaled feature; ``bias``."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """The logistic of the weighted features, of which each text has a vector of length 1 (of length 0 without a feature known from training)."""
        f = features(text)
        x = self.ratio[f]
        return float(1 / (1 + np.exp(-np.clip((self.weight[f] * x).sum() / (np.sqrt((x * x).sum()) + 1e-9) + self.bias, -60, 60))))


def log_count_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, alpha: float = 0.5) -> np.ndarray:
    """Naive Bayes log ratios of the shares of toxic and other texts that have a feature, shrunk smoothly where counts are small: by (z^2 / (z^2 + 10))^4, z being the ratio in standard errors.
    No feature is left out; one of no text has 0."""
    ratio = np.log((pos + alpha) / (n_pos + 2 * alpha)) - np.log((neg + alpha) / (n_neg + 2 * alpha))
    square = ratio**2 / (1 / (pos + alpha) + 1 / (neg + alpha))
    return np.where(pos + neg > 0, ratio * (square / (square + 10)) ** 4, 0.0)


class Fit:
    """Logistic regression on the scaled features by AdaGrad, a text at a time: memory is that of the weights, however many texts come. Both classes have equal weight in all."""

    def __init__(self, ratio: np.ndarray, n_pos: int, n_neg: int) -> None:
        self.ratio, self.weight, self.seen = ratio, np.zeros(len(ratio)), np.full(len(ratio), 1e-8)
        self.bias, self.bias_seen = 0.0, 1e-8
        self.each = {1: 0.5 * (n_pos + n_neg) / n_pos, 0: 0.5 * (n_pos + n_neg) / n_neg}

    def step(self, f: np.ndarray, y: int) -> None:
        x = self.ratio[f]
        x = x / (np.sqrt((x * x).sum()) + 1e-9)
        z = (self.weight[f] * x).sum() + self.bias
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * self.each[y]
        self.seen[f] += (g * x) ** 2
        self.weight[f] -= RATE * g * x / np.sqrt(self.seen[f])
        self.bias_seen += g * g
        self.bias -= RATE * g / np.sqrt(self.bias_seen)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS_PER_CLASS, epochs: int = EPOCHS) -> Model:
    """Fit on the labelled rows that are not held out: at most ``max_rows`` of each class, the first in hash order of their id.

    A repeated label counts once, the larger one; of rows with one id the text with the smallest hash is taken; null labels and ids are left out. One distributed pass over the sample sums per
    feature in how many texts of each class it occurs, at most 2^20 sums, none left out. Then one task streams the sample in a fixed hash order, ``epochs`` times, and updates the weights text by text; it holds
    no more than them. Without a row of either class every text gets the share of toxic labels, at least a thousandth.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = known.filter(fold("id") != 0)
    sample = known.filter("y = 1").orderBy(order_hash(F.col("id"))).limit(max_rows).unionByName(known.filter("y = 0").orderBy(order_hash(F.col("id"))).limit(max_rows))
    sample = F.broadcast(materialize(sample, "toxicity-labels"))  # at most 2 * max_rows rows of an id and a bit
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(sample, "id")
    texts = materialize(texts.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.crc32("text"))).alias("text")), "toxicity-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                sums[y, features(text.as_py())] += 1
        at = np.flatnonzero(sums.sum(axis=0))
        for i in range(0, len(at), 50_000):
            k = at[i : i + 50_000]
            yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(sums[1, k].astype(np.int64)), pa.array(sums[0, k].astype(np.int64))], names=["h", "pos", "neg"])

    sizes = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        odds = max((n_pos + 0.001) / (n_pos + n_neg + 1), 0.001)
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), float(np.log(odds / (1 - min(odds, 0.999)))))
    sums = texts.select("text", "y").mapInArrow(count, "h int, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    pos[sums.column("h").to_numpy()], neg[sums.column("h").to_numpy()] = sums.column("pos").to_numpy(), sums.column("neg").to_numpy()
    ratio = log_count_ratios(pos, neg, n_pos, n_neg)
    shared = spark.sparkContext.broadcast(ratio)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Fit(shared.value, n_pos, n_neg)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                state.step(features(text.as_py()), y)
        yield pa.record_batch([pa.array([state.weight.tobytes()], pa.binary()), pa.array([state.bias])], names=["weight", "bias"])

    order = ["epoch", F.xxhash64(F.lit("fit"), "epoch", "id"), "id"]
    stream = texts.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions(*order).select("text", "y")
    got = stream.mapInArrow(fit, "weight binary, bias double").collect()[0]
    return Model(ratio, np.frombuffer(bytes(got["weight"])), got["bias"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row, from the whole text; null and empty texts get the score of no features. No shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.fromiter((shared.value.score(t.as_py()) for t in batch.column(1)), float, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), (fold(id_col) == 0).alias("held_out")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in batch.column(at)]))

    return docs.mapInArrow(run, docs.schema)
