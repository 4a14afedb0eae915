"""Quality classifier: supervised subword embeddings.

Features of a text are its words (runs without white space), its character n-grams and, as a word
bigram of its own, the same word twice in a row; they are hashed to rows of one embedding table. A document is the average of its features' vectors; a softmax layer
gives the probability of label 1. Vectors and layer are learned together by stochastic gradient
descent in numpy, on a bounded sample: at most ``PER_LABEL`` labelled documents of each label, those
least by a hash of their id. Scoring covers every whole text inside Spark tasks: the model is linear
after averaging, so each feature row is reduced to its two logits beforehand, a table of fixed size.

Cases: an empty or null text scores as the learned prior; without labelled rows every score is 0.5;
null labels are not learned from; a document counts once for each label that it has, with its least text
where an id has several; repeated rows give a row each; an input column ``quality_score`` is replaced,
other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, list_values
from .textvec import byte_slices, mix, span_hashes, spans

BITS = 18
GRAMS = (3, 4)
WIDTH = 16
PER_LABEL = 2000
EPOCHS = 6
RATE = 0.5
SEED = 7


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature row, document) of every word, repeated word and n-gram, by document within each kind."""
    dark = np.ones(256, bool)
    dark[[9, 10, 11, 12, 13, 32]] = False
    starts, ends, doc = spans(dark[data], offsets)
    shift = np.uint64(64 - BITS)
    words = span_hashes(data, starts, ends)
    again = np.flatnonzero((words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
    rows, docs = [(words >> shift).astype(np.int32), np.zeros(len(again), np.int32)], [doc, doc[again]]
    place = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    wide = data.astype(np.uint64)
    for n in GRAMS:
        if len(data) < n:
            continue
        last = len(data) - n + 1
        gram = np.full(last, n, np.uint64)
        for j in range(n):
            gram = (gram << np.uint64(8)) | wide[j:last + j]
        inside = place[n - 1:] == place[:last]
        rows.append((mix(gram) >> shift).astype(np.int32)[inside])
        docs.append(place[:last][inside])
    return np.concatenate(rows), np.concatenate(docs)


def counted(rows: np.ndarray, doc: np.ndarray, n_docs: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct features and their shares, for each document."""
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(n_docs + 1))
    out = []
    for a, b in zip(cut[:-1], cut[1:]):
        row, n = np.unique(rows[order[a:b]], return_counts=True)
        out.append((row, (n / max(n.sum(), 1)).astype(np.float32)))
    return out


def fold(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


SAMPLE = pa.schema([("label", pa.int32()), ("rows", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, rows, shares) of the bounded sample of labelled documents outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", 5) != 0)).select(
        F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    order = F.xxhash64("_id")
    parts = [usable.where(F.col("label") == k).orderBy(order, "_id").limit(PER_LABEL) for k in (0, 1)]
    picked = parts[0].unionByName(parts[1])  # 2 * PER_LABEL rows of two numbers at most
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("_id", "label").agg(F.min("text").alias("text"))  # one text of an id that is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, end, data, offsets in byte_slices(batch.column(1)):
                found += counted(*features(data, offsets), len(offsets) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.list_(pa.int32())),
                 pa.array([x[1] for x in found], pa.list_(pa.float32()))], ["label", "rows", "shares"])

    return rows.select("label", "text").mapInArrow(run, "label int, rows array<int>, shares array<float>")


def train(sample: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(logits of every feature row, bias) after stochastic gradient descent."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    layer = np.zeros((2, WIDTH), np.float32)
    bias = np.zeros(2, np.float32)
    steps, step = EPOCHS * max(len(sample), 1), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sample)):
            label, rows, shares = sample[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            own = table[rows]
            mean = shares @ own
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= rate * np.float32(0.1) * error
            # a share is small: rows move by it times the number of features, as if seen one by one
            table[rows] = own - rate * np.minimum(shares * len(rows), 4)[:, None] * back
    return (table @ layer.T).astype(np.float32), bias


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(logits of every feature row, bias), trained by one task over the bounded sample."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(list(batches), schema=SAMPLE)
        sample = list(zip(found.column("label").to_pylist(), list_values(found, "rows"), list_values(found, "shares")))
        sample.sort(key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
        logits, bias = train([x for x in sample if len(x[1])])
        yield pa.RecordBatch.from_arrays([pa.array([logits.tobytes()]), pa.array([bias.tobytes()])], ["logits", "bias"])

    sample = training_sample(docs, labels).repartition(1)  # 2 * PER_LABEL rows at most
    model = sample.mapInArrow(run, "logits binary, bias binary").first()
    if model is None:
        return train([])
    return np.frombuffer(model["logits"], np.float32).reshape(-1, 2), np.frombuffer(model["bias"], np.float32)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` and quality_score, the probability of label 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("quality_score")
    logits, bias = model
    shared = spark.sparkContext.broadcast((logits[:, 1] - logits[:, 0], float(bias[1] - bias[0])))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, prior = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for start, end, data, offsets in byte_slices(batch.column(at)):
                rows, doc = features(data, offsets)
                n = end - start
                total = np.bincount(doc, gain[rows], minlength=n)
                out[start:end] = total / np.maximum(np.bincount(doc, minlength=n), 1)
            out = 1 / (1 + np.exp(-(out + prior)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "quality_score"])

    schema = docs.withColumn("quality_score", F.lit(0.0).cast("double")).schema
    return docs.mapInArrow(run, schema)
