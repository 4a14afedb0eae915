"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (one to three code points, lower-cased) are hashed to ``2**BITS`` columns. IDF comes
from the document frequencies of all documents to learn from. Weights are trained by
follow-the-regularised-leader with elastic-net penalties (L1 keeps them sparse, L2 shrinks them) on a
bounded sample, about ``PER_LANGUAGE`` documents of each language; a fifth of the sample is set aside
to calibrate the probabilities by one temperature. TF-IDF values are normalised by their sum, so a
document's logits are sums over its n-grams and whole texts are scored slice by slice.

Cases: a null text or one without letters is ``und`` with score 0; so is every text if there is
nothing to learn from; equal logits go to the first language by name; null languages are not learned
from; repeated rows give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, list_values
from .textvec import byte_slices, mix

BITS = 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1200
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
SCALE = 20.0
SEED = 11


def lower_table() -> np.ndarray:
    """Lower case of the code points of the basic plane, where it is one code point."""
    out = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        low = chr(c).lower()
        if len(low) == 1 and not 0xD800 <= c < 0xE000:
            out[c] = ord(low)
    return out


_lower: list[np.ndarray] = []


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column, document) of every n-gram occurrence, by document within each order."""
    if not _lower:
        _lower.append(lower_table())
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    ends = np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets]
    points = np.where(points < 0x10000, _lower[0][np.minimum(points, 0xFFFF)], points).astype(np.uint64)
    place = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    rows, docs = [], []
    for n in ORDERS:
        last = len(points) - n + 1
        if last <= 0:
            continue
        key = np.full(last, n, np.uint64)
        for j in range(n):
            key = (key << np.uint64(21)) ^ points[j:last + j]
        inside = place[n - 1:] == place[:last]
        rows.append((mix(key) >> np.uint64(64 - BITS)).astype(np.int32)[inside])
        docs.append(place[:last][inside])
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(docs)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """IDF of every column over all rows of ``docs``: a table of fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for start, end, data, offsets in byte_slices(batch.column(0)):
                rows, doc = grams(data, offsets)
                for low in range(0, end - start, 256):
                    own = (doc >= low) & (doc < low + 256) if end - start > 256 else slice(None)
                    seen = np.zeros((min(256, end - start - low), 1 << BITS), bool)
                    seen[doc[own] - low, rows[own]] = True
                    total += seen.sum(0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n))],
                                         ["column", "df"])

    counts = docs.select("text").mapInArrow(count, "column int, df long").groupBy("column").agg(F.sum("df").alias("df"))
    counts = counts.toPandas()
    n = int(counts.df[counts.column == -1].sum())
    df = np.zeros(1 << BITS)
    counts = counts[counts.column >= 0]
    df[counts.column.to_numpy()] = counts.df.to_numpy()
    return (np.log((n + 1) / (df + 1)) + 1).astype(np.float32)


def share_of(rows: int) -> int:
    """How many of 2**60 hash values are sampled so that about PER_LANGUAGE of ``rows`` are."""
    return (PER_LANGUAGE << 60) // max(rows, PER_LANGUAGE)


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text, order) of about PER_LANGUAGE documents of each language, chosen by a hash of the row."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return known.limit(0).select("lang", "text", F.lit(0).cast("long").alias("order"))
    share = F.create_map(*[x for row in sizes for x in (F.lit(row["lang"]), F.lit(share_of(row["count"])))])
    order = F.xxhash64("doc_id", "lang", "text")
    picked = known.withColumn("order", order).where(F.shiftrightunsigned("order", 4) < share[F.col("lang")])
    keys = picked.select("doc_id", "lang", "order").orderBy("order", "doc_id").limit(2 * PER_LANGUAGE * len(sizes))
    keys = keys.select(F.max("order").alias("last"))  # the bound holds whatever ids repeat
    return picked.join(F.broadcast(keys), F.col("order") <= F.col("last")).select("lang", "text", "order").limit(
        2 * PER_LANGUAGE * len(sizes))


def vectors(texts: DataFrame) -> DataFrame:
    """(lang, order, columns, counts): sparse n-gram counts of the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offsets in byte_slices(batch.column(1)):
                rows, doc = grams(data, offsets)
                order = np.argsort(doc, kind="stable")
                cut = np.searchsorted(doc[order], np.arange(len(offsets)))
                found += [np.unique(rows[order[a:b]], return_counts=True) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x[0] for x in found], pa.list_(pa.int32())),
                 pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["lang", "order", "columns", "counts"])

    return texts.mapInArrow(run, "lang string, order long, columns array<int>, counts array<long>")


def normalised(columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = counts * idf[columns]
    return (SCALE * value / max(value.sum(), 1e-9)).astype(np.float32)


class FollowTheLeader:
    """Multinomial logistic regression by FTRL-proximal, a coordinate's rate falling with its gradients."""

    def __init__(self, n_columns: int, n_classes: int):
        self.z = np.zeros((n_columns, n_classes), np.float32)
        self.n = np.zeros((n_columns, n_classes), np.float32)

    def weights(self, columns) -> np.ndarray:
        z, n = self.z[columns], self.n[columns]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.float32(L1), 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, columns: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(columns)
        logits = value @ w
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[label] -= 1
        g = value[:, None] * p
        n = self.n[columns]
        grown = n + g * g
        self.z[columns] += g - (np.sqrt(grown) - np.sqrt(n)) / np.float32(ALPHA) * w
        self.n[columns] = grown


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(labels)), labels]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """languages (sorted), idf, weights (a row for each column and one for the bias), temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, t: float):
        self.languages, self.idf, self.weights, self.t = languages, idf, weights, t


def fit(docs: DataFrame) -> Model:
    """Learn from the texts and non-null languages of ``docs``."""
    bounded_batches(docs.sparkSession)
    idf = inverse_frequencies(docs.where("text is not null and lang is not null"))
    table = vectors(training_sample(docs)).toArrow()
    names, order = table.column("lang").to_pylist(), table.column("order").to_pylist()
    found = list(zip(order, names, list_values(table, "columns"), list_values(table, "counts")))
    found.sort(key=lambda x: (x[0], x[1], len(x[2])))
    languages = sorted(set(names))
    bias = 1 << BITS
    sample = []
    for _, name, columns, counts in found:
        value = normalised(columns, counts, idf)
        sample.append((np.append(columns, np.int32(bias)), np.append(value, np.float32(1)), languages.index(name)))
    rng = np.random.default_rng(SEED)
    shuffled = rng.permutation(len(sample))
    aside = {int(i) for i in shuffled[:len(sample) // 5]}
    leader = FollowTheLeader(bias + 1, max(len(languages), 1))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(sample)):
            if int(i) not in aside:
                leader.learn(*sample[i])
    weights = leader.weights(slice(None))
    rest = [sample[i] for i in sorted(aside)]
    logits = np.array([value @ weights[columns] for columns, value, _ in rest]).reshape(len(rest), weights.shape[1])
    return Model(languages, idf, weights, temperature(logits, np.array([x[2] for x in rest], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the key columns of ``docs`` besides text, with lang_pred and score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.languages)
        gain = (m.weights[:-1] * m.idf[:, None]).astype(np.float32) * np.float32(SCALE)
        for batch in batches:
            logits = np.zeros((batch.num_rows, max(k, 1)))
            for start, end, data, offsets in byte_slices(batch.column(1)):
                columns, doc = grams(data, offsets)
                n = end - start
                norm = np.maximum(np.bincount(doc, m.idf[columns], minlength=n), 1e-9)
                for c in range(k):
                    logits[start:end, c] = np.bincount(doc, gain[columns, c], minlength=n) / norm + m.weights[-1, c]
            p = np.exp((logits - logits.max(1, keepdims=True)) / m.t)
            p /= p.sum(1, keepdims=True)
            best = logits.argmax(1)
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(bool) & (k > 0)
            names = [m.languages[b] if ok else "und" for b, ok in zip(best, known)]
            score = np.where(known, p[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
