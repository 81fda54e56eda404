"""Quality classifier: supervised subword embeddings.

Each word, each character n-gram of a word (with its edges) and each repetition of a word within LAGS words
is hashed to a row of an embedding table; a document is the mean of its rows, a softmax layer gives its label, and both are trained by stochastic
gradient descent in numpy on at most TRAIN_ROWS labelled documents (in the order of a hash of their ids).
As the layer is linear, a row's embedding times the layer is one number per hash, so that scoring a text is
the mean of looked-up numbers: the same score, whatever the embedding's width.

Texts are read as they are (case and symbols tell quality). Null and empty texts have no features and score
by the bias alone. Repeated labels each count; labels other than 0 and 1, and null ones, are not learned
from; without both labels to learn from, every score is 0.5. Other columns are never inputs. An empty table gives
no rows; repeated rows give repeated rows with equal scores. A score equal to the cut is predicted 1. Very long texts
are scored whole: BLOCK bytes of texts at a time, a longer text alone, with work arrays some 40 times its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.common import IS_SPACE, blocks, reachable, span_hashes, table, utf8, word_spans
from fathom.llm.langid import remainder

TRAIN_ROWS = 2000
BITS = 16
GRAMS = (2, 3, 4)
#: A word that repeats the one so many words before it has a feature of its own for each such distance.
LAGS = 12
BUCKETS = ((1 + len(GRAMS)) << BITS) + LAGS
WIDTH, EPOCHS, RATE, SEED = 8, 8, 0.4, 11
CUT = 0.3
#: Bytes of text scored at a time.
BLOCK = 1 << 18


def gram_features(text: np.ndarray, edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each n-gram of bytes inside a word, its neighbouring spaces included; edge: where rows start."""
    if len(text) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = IS_SPACE[text]
    plain = np.where(space, np.uint8(32), text).astype(np.uint32)
    count = len(text) - n + 1
    key, whole = plain[:count].copy(), np.ones(count, bool)
    for i in range(1, n):
        key |= plain[i : i + count] << np.uint32(8 * i)
        whole &= ~edge[i : i + count]
        if i < n - 1:
            whole &= ~space[i : i + count]
    if n == 2:
        whole &= ~(space[:count] & space[1 : 1 + count])
    where = np.flatnonzero(whole)
    with np.errstate(over="ignore"):
        return where, (key[where] * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (from offsets[0]) and feature numbers of the rows' words, then of their n-grams."""
    text = data[offsets[0] : offsets[-1]]
    first, end, row = word_spans(data, offsets)
    words = span_hashes(text, first, end)
    yield first, (words >> np.uint64(64 - BITS)).astype(np.int64)
    new = np.ones(len(words), bool)
    for lag in range(1, LAGS + 1):
        same = np.flatnonzero((words[lag:] == words[:-lag]) & (row[lag:] == row[:-lag]) & new[lag:]) + lag
        new[same] = False
        yield first[same], np.full(len(same), BUCKETS - lag)
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets - offsets[0]] = True
    for k, n in enumerate(GRAMS):
        where, at = gram_features(text, edge[:-1], n)
        yield where, at + ((k + 1) << BITS)


@dataclass
class Model:
    """logit[feature] and bias: the two-label softmax of the mean embedding, as the difference of its logits."""

    logit: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for a, b in blocks(offsets, BLOCK):
            own = offsets[a : b + 1] - offsets[a]
            total, count = np.zeros(own[-1] + 1), np.zeros(own[-1] + 1)
            for where, at in features(data, offsets[a : b + 1]):
                total[1:] += np.bincount(where, self.logit[at], own[-1])[: own[-1]]
                count[1:] += np.bincount(where, minlength=own[-1])[: own[-1]]
            sums, counts = np.diff(np.cumsum(total)[own]), np.diff(np.cumsum(count)[own])
            out[a:b] = 1 / (1 + np.exp(-(sums / np.maximum(counts, 1) + self.bias)))
        return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its label, distinct features and their shares."""
    for b in batches:
        data, offsets = utf8(b.column(2))
        for i in range(b.num_rows):
            ids = np.concatenate([at for _, at in features(data, offsets[i : i + 2])])
            ids, n = np.unique(ids, return_counts=True)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([(n / max(1, n.sum())).astype(np.float32)], pa.list_(pa.float32()))], names=["at", "label", "ids", "shares"])


def train(docs: DataFrame, labels: DataFrame, held: Column) -> Model:
    """Learns from the labelled rows that are not held out."""
    reachable(docs.sparkSession)
    wanted = labels.where(~held & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    sample = wanted.orderBy(F.xxhash64("label_id"), "label").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # TRAIN_ROWS rows at most
    rows = rows.orderBy(F.xxhash64("label_id", "text"), "label").limit(TRAIN_ROWS)  # ids may repeat
    bags = rows.select(F.xxhash64("label_id").alias("at"), "label", "text").mapInArrow(_bags, "at long, label int, ids array<int>, shares array<float>")
    got = [(np.asarray(i, np.int64), np.asarray(s, np.float32), y) for b in bags.orderBy("at", "label").toArrow().to_batches() for y, i, s in zip(b.column(1).to_pylist(), (x.values.to_numpy() for x in b.column(2)), (x.values.to_numpy() for x in b.column(3)), strict=True)]
    return fit(got)


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    if len({y for _, _, y in bags}) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(SEED)
    embed = (rng.random((BUCKETS, WIDTH), np.float32) - np.float32(0.5)) / np.float32(WIDTH)
    out, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, shares, label = bags[i]
            rate = np.float32(RATE * (1 - done / steps))
            rows = embed[ids]
            mean = shares @ rows
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * np.float32(0.1) * p
            embed[ids] = rows - (rate * len(ids)) ** np.float32(0.5) * shares[:, None] * back
            done += 1
    return Model((embed @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with the score (0 to 1) last, as column `name`; an existing column of that name is replaced."""
    reachable(docs.sparkSession)
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(*utf8(b.column(at))))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` double"]))


def model_of(spark: SparkSession, sf_dir: str) -> Model:
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) == 0)


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), model_of(spark, sf_dir))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
