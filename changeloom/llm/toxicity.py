"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other. Each is a logistic model over the presence of words and
the probabilities of the categories before it; in training those are out-of-fold predictions (FOLDS
folds by a hash of doc_id), so later models see earlier ones as good as they are on new texts.

Labels tell documents that are toxic from others, without kinds. The chain's first categories are kinds
found in the data: the toxic training texts in KINDS groups by the words that tell them from the others
(k-means over their presence). The last category is the label.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import class_counts, pick, remainder, within_bytes
from .storage import bound_batches, release_memory
from .textbytes import LOWER, NON_ALNUM, arrow_texts, chunks, mix, span_hashes, word_spans

FOLDS = 5
SAMPLE_PER_CLASS = 4000
STEMS = (4, 5, 6)  #: bytes of a word's beginning that are features too
MOST_WORDS = 512  #: features of a model: the words that tell its category best
LEAST_Z = 4.5
LEAST_RATIO = 4.0  #: of a feature's shares in both classes; others only tell long texts from short ones
THRESHOLD = 0.5
KINDS = 2
KIND_WORDS = 64  #: words by which the toxic texts are grouped
CATEGORIES = (*(f"kind{k + 1}" for k in range(KINDS)), "toxic")
SAMPLE_BYTES = 24 << 20  #: of text to train on, at most; its features take about three times as many on the driver
MOST_STEPS = 100
TOLERANCE = 1e-4


def word_sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's words (A-Z in lower case) and of their first STEMS bytes."""
    for _, part, po in chunks(data, offs):
        low = LOWER[part]
        starts, ends, first = word_spans(low, po, NON_ALNUM)
        h = [span_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)]
        for n in STEMS:  # a word no longer than that is a feature by itself already
            h.append(np.where(ends - starts > n, mix(span_hashes(low, starts, np.minimum(starts + n, ends)) + np.uint64(n)), h[0]) if len(starts) else h[0])
        h = np.stack(h, 1)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(h[a:b])


class Linear:
    """Logistic regression on the presence of `words`, and on `extra` numbers given beside them."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, extra: np.ndarray, bias: float):
        self.words, self.weights, self.extra, self.bias = words, weights, extra, bias

    def raw(self, present: np.ndarray, more: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(present @ self.weights + more @ self.extra + self.bias, -50, 50)))


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All features of all texts, and the text of each."""
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def _present(flat: np.ndarray, text: np.ndarray, n: int, words: np.ndarray) -> np.ndarray:
    """(texts, words) of 0 and 1; words are sorted."""
    out = np.zeros((n, len(words)))
    if len(words) and len(flat):
        at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
        hit = words[at] == flat
        out[text[hit], at[hit]] = 1
    return out


class Table:
    """The features of the training texts, looked up once for all models of a chain."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        flat, text = _flat(sets)
        words, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = count > 2
        keep = often[at]
        self.words, self.text = words[often], text[keep]
        self.at = (np.cumsum(often) - 1)[at[keep]]
        self.flat = flat[keep]

    def telling(self, y: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words whose shares in both classes of the texts in `rows` differ clearly, the most telling first, and how much."""
        mine = rows[self.text]
        at, label = self.at[mine], y[self.text[mine]]
        n1, n0 = max(1, y[rows].sum()), max(1, (1 - y[rows]).sum())
        c1, c0 = np.bincount(at, label, len(self.words)), np.bincount(at, 1 - label, len(self.words))
        both = (c1 + c0) / (n1 + n0)
        z = (c1 / n1 - c0 / n0) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n1 + 1 / n0))
        ratio = (c1 / n1 + 1e-6) / (c0 / n0 + 1e-6)
        good = np.flatnonzero((np.abs(z) >= LEAST_Z) & (np.maximum(ratio, 1 / ratio) >= LEAST_RATIO))
        good = good[np.argsort(-np.abs(z[good]).round(9), kind="stable")]
        return good, z[good]

    def fit(self, more: np.ndarray, y: np.ndarray, rows: np.ndarray) -> Linear:
        """A model from the texts in the mask `rows`."""
        good = np.sort(self.telling(y, rows)[0][:MOST_WORDS])
        words = self.words[good]
        x = np.hstack([_present(self.flat, self.text, self.n, words), more, np.ones((self.n, 1))])[rows].astype(np.float32)
        w = ridge(x, y[rows])
        k = len(words)
        return Linear(words, w[:k], w[k:-1], float(w[-1]))

    def kinds(self, toxic: np.ndarray) -> np.ndarray:
        """(texts, KINDS) of 0 and 1: each toxic text with a telling word is of one kind.

        The groups begin with the texts of the most telling word, and of the one that is least often in the same texts
        as those before; then each text goes to the group whose mean it is nearest to, by cosine, until none moves.
        """
        out = np.zeros((self.n, KINDS))
        good, z = self.telling(toxic.astype(float), np.ones(self.n, bool))
        good = good[z > 0][:KIND_WORDS]
        x = _present(self.flat, self.text, self.n, self.words[np.sort(good)])[:, np.argsort(np.argsort(good))]
        mine = np.flatnonzero(toxic & x.any(1))
        if not len(mine):
            return out
        x = x[mine] / np.linalg.norm(x[mine], axis=1, keepdims=True)
        has = x > 0
        first = [0]
        while len(first) < KINDS:
            together = (has & has[:, first].any(1)[:, None]).sum(0) / has.sum(0)
            first.append(int(np.argmin(together.round(9))))
        centre = np.stack([x[has[:, f]].mean(0) for f in first])
        group = None
        for _ in range(MOST_STEPS):
            near = (x @ (centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)).T).round(9).argmax(1)
            if group is not None and (near == group).all():
                break
            group = near
            centre = np.stack([x[group == k].mean(0) if (group == k).any() else centre[k] for k in range(KINDS)])
        out[mine, group] = 1
        return out


def ridge(x: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Weights of a logistic model with a ridge, the last column's is free; Newton steps, halved until the loss falls, to convergence or an error."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 1.0)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = (x @ w.astype(np.float32)).astype(float)
        return float((np.logaddexp(0, z) - goal * z).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(MOST_STEPS):
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32)).astype(float), -50, 50)))
        h = (x * (p * (1 - p)).astype(np.float32)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, ((goal - p).astype(np.float32) @ x) - penalty * w)
        for _ in range(30):
            then = loss(w + step)
            if then <= now + 1e-5 * max(1.0, abs(now)):
                break
            step = step / 2
        w, now = w + step, then
        if np.abs(step).max() < TOLERANCE:
            return w
    raise RuntimeError("the fit did not converge")


class Chain:
    def __init__(self, models: list[Linear]):
        self.models = models

    def predict(self, sets: list[np.ndarray]) -> np.ndarray:
        """Probabilities (texts, categories)."""
        out = np.zeros((len(sets), len(self.models)))
        flat, text = _flat(sets)
        for k, m in enumerate(self.models):
            out[:, k] = m.raw(_present(flat, text, len(sets), m.words), out[:, :k])
        return out


def fit_chain(sets: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, kinds: np.ndarray | None = None) -> Chain:
    """toxic: 0 or 1 of each text; fold: each text's fold; kinds (texts, n) of 0 and 1, found in the data if not given."""
    table, every = Table(sets), np.ones(len(sets), bool)
    labels = np.hstack([table.kinds(toxic.astype(bool)) if kinds is None else kinds, toxic[:, None]]).astype(float)
    models, earlier = [], np.zeros(labels.shape)
    for k in range(labels.shape[1]):
        y, more = labels[:, k], earlier[:, :k]
        models.append(table.fit(more, y, every))
        for f in range(FOLDS if k + 1 < labels.shape[1] else 0):
            own = fold == f
            if own.any() and not own.all():
                m = table.fit(more, y, ~own)
                earlier[own, k] = m.raw(_present(table.flat, table.text, table.n, m.words), more)[own]
    return Chain(models)


def fold_of(doc_id: int) -> int:
    return crc32(b"fold" + str(doc_id).encode()) % FOLDS


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_bytes: int = SAMPLE_BYTES) -> Chain | None:
    """A chain from labels (doc_id, toxic) of documents whose crc32(doc_id) mod 4 is not 2. None without labels.

    Trained on at most about 2 * per_class texts of at most `most_bytes` together, chosen by a hash of doc_id.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max("toxic").cast("int").alias("label"))
    sample = pick(known, "label", class_counts(known, "label"), per_class, "of")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            blobs = [s.tobytes() for s in word_sets(*arrow_texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("of"), batch.column("label"), pa.array(blobs, pa.binary())], ["of", "label", "words"])

    texts = bound_batches(docs).select(F.col("doc_id").cast("long").alias("of"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = within_bytes(texts, sample, 2, most_bytes)
    got = texts.join(F.broadcast(sample), "of").mapInArrow(run, "of long, label int, words binary").toArrow().sort_by("of")
    sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in got.column("words")]
    if not sets:
        return None
    chain = fit_chain(sets, got.column("label").to_numpy().astype(int), np.array([fold_of(d) for d in got.column("of").to_pylist()]))
    del got, sets
    release_memory()
    return chain


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, ...), labels (doc_id, toxic) -> (doc_id, p_kind1, p_kind2, p_toxic, toxic int), a row for each row of docs.

    Null and empty texts have no words and get the probabilities of such texts; without labels all are 0. Rows
    that repeat a doc_id or have none are scored like any other. Other columns are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = [f"p_{c}" for c in CATEGORIES]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        for batch in it:
            sets = list(word_sets(*arrow_texts(batch.column("text"))))
            p = chain.predict(sets) if chain else np.zeros((len(sets), len(names)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array((p[:, -1] >= threshold).astype(np.int32))], ["doc_id", *names, "toxic"])

    rows = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{n} double' for n in names)}, toxic int")
