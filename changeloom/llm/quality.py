"""Quality classifier of supervised subword embeddings, trained in numpy.

A text's features are its words, its words' shapes (case, letters and other signs, whether it repeats
the word before) and its byte 3- and 4-grams, each hashed to a row of one embedding table. The text's
vector is the mean of its rows; a softmax layer gives the classes. Table and layer are learned
together by stochastic gradient descent (Adagrad) on a bounded sample of labelled rows.

As everything behind the table is linear up to the softmax, scoring needs one number per feature:
the row times the difference of the two output vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import class_counts, pick, remainder, within_bytes
from .storage import bound_batches, fresh_name, release_memory, tidy
from .textbytes import SPACE, arrow_texts, chunks, span_hashes, word_spans

BITS = 18
DIM = 8
SAMPLE_PER_CLASS = 1500  #: labelled rows of each class to train on
SAMPLE_BYTES = 16 << 20  #: and of so many bytes of text at most; their features take about five times as many on the driver
EPOCHS = 8
_KINDS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower or non-ASCII, 3 digit
_KINDS[0x41:0x5B], _KINDS[0x61:0x7B], _KINDS[0x80:], _KINDS[0x30:0x3A] = 1, 2, 2, 3


def _fold(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def _gram_rows(data: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(data) - n + 1), np.uint32)
    for k in range(n):
        h = (h ^ data[k : k + len(h)]) * np.uint32(0x01000193 + 2 * n)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)).astype(np.int32)


def features(part: np.ndarray, po: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups (rows of the table, n + 1 offsets of documents) for a chunk of texts."""
    starts, ends, first = word_spans(part, po, SPACE)
    words = span_hashes(part, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    yield _fold(words), first
    if len(starts):
        kinds = _KINDS[part]
        size = ends - starts
        share = {}
        for k in (0, 1, 3):
            upto = np.zeros(len(part) + 1, np.int32 if len(part) < 1 << 31 else np.int64)
            np.cumsum(kinds == k, out=upto[1:])
            share[k] = np.minimum(3, 4 * (upto[ends] - upto[starts]).astype(np.int64) // size).astype(np.uint64)
        again = np.zeros(len(words), np.uint64)
        again[1:] = words[1:] == words[:-1]
        again[first[(first > 0) & (first < len(words))]] = 0
        shape = (((share[0] * np.uint64(4) + share[1]) * np.uint64(4) + share[3]) * np.uint64(2) + again) * np.uint64(16) + np.minimum(15, size).astype(np.uint64)
        rows = _fold((shape + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        bare = _fold(((shape >> np.uint64(4)) + np.uint64(5000)) * np.uint64(0x9E3779B97F4A7C15))
        yield np.stack([rows, bare], 1).ravel(), first * 2
    else:
        yield np.zeros(0, np.int32), first
    for n in (3, 4):
        rows = _gram_rows(part, n)
        keep = np.ones(len(rows), bool)
        for k in range(1, n):  # no gram reaches into the next document
            at = po[1:-1] - k
            keep[at[(at >= 0) & (at < len(rows))]] = False
        yield rows[keep], np.concatenate([[0], np.cumsum(keep)])[np.minimum(po, len(rows))]


def _sparse(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct table rows and their counts in each text."""
    for batch in it:
        data, offs = arrow_texts(batch.column("text"))
        ids, shares = [], []
        for _, part, po in chunks(data, offs):
            groups = list(features(part, po))
            for d in range(len(po) - 1):
                rows, n = np.unique(np.concatenate([r[o[d] : o[d + 1]] for r, o in groups]), return_counts=True)
                ids.append(rows.astype(np.int32).tobytes())
                shares.append(np.minimum(65535, n).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["label", "ids", "counts"])


class QualityModel:
    """weights: one number per table row; the score is sigmoid(bias + mean weight)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = []
        for _, part, po in chunks(data, offs):
            total, n = np.zeros(len(po) - 1), np.zeros(len(po) - 1)
            for rows, o in features(part, po):
                run = np.concatenate([[0.0], np.cumsum(self.weights[rows], dtype=np.float64)])
                total += run[o[1:]] - run[o[:-1]]
                n += np.diff(o)
            out.append(1 / (1 + np.exp(-(self.bias + total / np.maximum(1, n)))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(labels: np.ndarray, ids: list[np.ndarray], times: list[np.ndarray], prior: float, seed: int = 11) -> QualityModel:
    """Embedding table and softmax layer by Adagrad steps over batches of 32 texts; prior: the share of label 1 in all labelled rows."""
    rng = np.random.default_rng(seed)
    table = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    seen_t, seen_o = np.full(1 << BITS, 1e-4, np.float32), np.full((DIM, 2), 1e-2, np.float32)
    rate = 0.6
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), 32):
            batch = order[i : i + 32]
            n = np.array([len(ids[k]) for k in batch])
            if not n.sum():
                continue
            rows, w = np.concatenate([ids[k] for k in batch]), np.concatenate([times[k] / max(1, times[k].sum(dtype=np.int64)) for k in batch]).astype(np.float32)
            doc = np.repeat(np.arange(len(batch)), n)
            full = np.flatnonzero(n)
            vec = np.zeros((len(batch), DIM), np.float32)
            vec[full] = np.add.reduceat(table[rows] * w[:, None], (np.cumsum(n) - n)[full], axis=0)
            logit = vec @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            g_out, g_vec = vec.T @ p, p @ out.T
            seen_o += g_out**2
            bias -= rate * 0.02 * p.sum(0)
            part = g_vec[doc] * w[:, None]
            touched, where = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(where, part[:, d], len(touched)) for d in range(DIM)], 1).astype(np.float32)
            seen_t[touched] += (grad**2).mean(1)
            table[touched] -= rate * grad / np.sqrt(seen_t[touched])[:, None] * 0.2
            if not out.any():
                out += rng.normal(0, 0.3, out.shape).astype(np.float32)
            out -= rate * g_out / np.sqrt(seen_o) * 0.2
        rate *= 0.7
    share = min(max(float(labels.mean()) if len(labels) else 0.5, 1e-3), 1 - 1e-3)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return QualityModel(table @ (out[:, 1] - out[:, 0]), bias[1] - bias[0] + shift)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """A model from labels (doc_id, quality) of documents whose crc32(doc_id) mod 4 is not 2.

    At most about 2 * per_class labelled texts, of at most `most_bytes` together, are used, chosen by a hash of
    doc_id; their sparse features (not texts) come to the driver. Without usable labels every score is 0.5.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max("quality").cast("int").alias("label"))
    counts = class_counts(known, "label")
    sample = pick(known, "label", counts, per_class, "of")
    texts = bound_batches(docs).select(F.col("doc_id").cast("long").alias("of"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = within_bytes(texts, sample, 2, most_bytes)
    got = texts.join(F.broadcast(sample), "of").select("label", "text").mapInArrow(_sparse, "label int, ids binary, counts binary").toArrow()
    y = got.column("label").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return QualityModel(np.zeros(1 << BITS), 0.0)
    ids = [np.frombuffer(b.as_buffer(), np.int32) for b in got.column("ids")]
    times = [np.frombuffer(b.as_buffer(), np.uint16) for b in got.column("counts")]
    # arrival order must not matter
    key = sorted(range(len(y)), key=lambda k: (int(y[k]), crc32(ids[k]), len(ids[k])))
    model = fit(y[key], [ids[k] for k in key], [times[k] for k in key], counts.get(1, 0) / sum(counts.values()))
    del got, ids, times
    release_memory()
    return model


def score(docs: DataFrame, model: QualityModel, column: str | None = None) -> DataFrame:
    """docs (text, ...) with their score (0 to 1) as a last column.

    It is called `column`, or else `__score` or, if docs has that, a longer name. Null and empty texts get the
    score of no features; rows that repeat a doc_id or have none are scored like any other.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    column = column or fresh_name(docs.columns, "__score")
    from pyspark.sql import types as T

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = held.value.score(*arrow_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, column])

    return bound_batches(docs).mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


THRESHOLD = 0.7


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, quality, ...) -> (doc_id, held_out, score, predicted), a row for each row of docs.

    Null and empty texts get the score of no features; without labels of both kinds every score is 0.5; held_out
    is null for a row without doc_id. Other columns are ignored, whatever their names.
    """
    scored = score(docs.select("doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score is under THRESHOLD; all columns are kept, whatever their names.

    Null and empty texts are judged by the score of no features, so all of them stay or go; without labels of both
    kinds every score is 0.5 and all rows go.
    """
    column = fresh_name(docs.columns, "__score")
    return score(docs, train(docs, labels), column).where(F.col(column) >= THRESHOLD).drop(column)
