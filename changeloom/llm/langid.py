"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of WINDOW bytes (the last one padded with zeros). Bytes are embedded;
filters of several widths run over the window, their rectified outputs are max-pooled, and a softmax
layer gives the language. A text's log probabilities are the mean of its windows', weighted by bytes.
Embedding times filter is one table per filter position, so applying a filter is a lookup per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import class_counts, pick, remainder
from .storage import bound_batches, release_memory
from .textbytes import arrow_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8  #: of each width
EMBED = 8
SAMPLE_PER_LANGUAGE = 1200  #: documents of each language to train on, with WINDOWS_EACH windows
WINDOWS_EACH = 3
BATCH_WINDOWS = 2048
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def cut_windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (k, WINDOW), zero-padded; the bytes in each; n + 1 offsets of documents' windows."""
    size = np.diff(offs)
    n = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(size)), n)
    start = offs[:-1][doc] + WINDOW * (np.arange(first[-1]) - first[:-1][doc])
    filled = np.minimum(WINDOW, offs[1:][doc] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    w = padded[start[:, None] + np.arange(WINDOW)]
    w[np.arange(WINDOW) >= filled[:, None]] = 0
    return w, filled, first


class ByteConvNet:
    def __init__(self, languages: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.shift, self.out, self.bias]

    def pooled(self, w: np.ndarray, where: bool = False):
        """Max-pooled outputs (k, widths * FILTERS), and the positions of the maxima if asked for."""
        tops, ats = [], []
        for width, f, s in zip(WIDTHS, self.filters, self.shift, strict=True):
            n = w.shape[1] - width + 1
            y = (self.embed @ f[0])[w[:, :n]]
            for k in range(1, width):
                y += (self.embed @ f[k])[w[:, k : k + n]]
            if where:
                at = y.argmax(1)
                ats.append(at)
                tops.append(np.take_along_axis(y, at[:, None, :], 1)[:, 0] + s)
            else:
                tops.append(y.max(1) + s)
        h = np.concatenate(tops, 1)
        return (np.maximum(h, 0), ats, h) if where else np.maximum(h, 0)

    def log_probabilities(self, w: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(w), 256):
            z = self.pooled(w[i : i + 256]) @ self.out + self.bias
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, x: np.ndarray, goal: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, for each of params(); the gradient of a maximum goes to its place alone."""
        h, ats, raw = self.pooled(x, True)
        z = h @ self.out + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(x)), goal] -= 1
        p /= len(x)
        gh = (p @ self.out.T) * (raw > 0)
        grads = [np.zeros_like(self.embed), *(np.zeros_like(f) for f in self.filters), np.zeros_like(self.shift), h.T @ p, p.sum(0)]
        for j, (width, f, at) in enumerate(zip(WIDTHS, self.filters, ats, strict=True)):
            g = gh[:, j * FILTERS : (j + 1) * FILTERS]
            grads[-3][j] = g.sum(0)
            for k in range(width):
                b = np.take_along_axis(x, at + k, 1)  # the byte under filter position k at each maximum
                e = self.embed[b]
                grads[1 + j][k] = np.einsum("nfe,nf->ef", e, g)
                np.add.at(grads[0], b.ravel(), (g[:, :, None] * f[k].T[None]).reshape(-1, EMBED))
        return grads

    def fit(self, w: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, seed: int = 5) -> None:
        """Adam on the cross-entropy, at least about 300 steps."""
        epochs = max(epochs, min(100, 300 * batch // max(1, len(w))))
        rng, params = np.random.default_rng(seed), self.params()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(w))
            for i in range(0, len(order), batch):
                x, goal = w[order[i : i + batch]], y[order[i : i + batch]]
                grads = self.gradients(x, goal)
                t += 1
                step = 0.004 * 0.6 ** (5 * epoch / epochs)
                for q, g, a, c in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    c += 0.001 * (g * g - c)
                    q -= step * (a / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each text's language and its probability; texts in runs of about BATCH_WINDOWS windows."""
        n = len(offs) - 1
        sums = np.zeros((n, len(self.languages)))
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + BATCH_WINDOWS * WINDOW, "right")) - 1))
            w, filled, first = cut_windows(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            logp = self.log_probabilities(w) * filled[:, None]
            run = np.concatenate([np.zeros((1, logp.shape[1])), np.cumsum(logp, 0, dtype=np.float64)])
            sums[i:j] = (run[first[1:]] - run[first[:-1]]) / np.maximum(1, np.diff(offs[i : j + 1]))[:, None]
            i = j
        z = np.exp(sums - sums.max(1, keepdims=True)) if n else sums
        z /= np.maximum(z.sum(1, keepdims=True), 1e-30)
        return z.argmax(1) if n else np.zeros(0, np.int64), z.max(1) if n else np.zeros(0)


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> ByteConvNet | None:
    """A network from text and non-null lang of documents whose crc32(doc_id) mod 5 is not 0.

    Trained on about `per_language` documents of each language, chosen by a hash of doc_id, with up to
    WINDOWS_EACH windows spread over each text. None if no row can be learned from.
    """
    rows = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (remainder(F.col("doc_id"), 5) != 0))
    counts = class_counts(docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang")).where(remainder(F.col("doc_id"), 5) != 0), "lang")

    def some(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            w, filled, first = cut_windows(*arrow_texts(batch.column("text")))
            out = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                at = sorted(set(np.linspace(a, b - 1, WINDOWS_EACH).astype(int).tolist())) if b > a else []
                out.append(b"".join(w[k].tobytes() for k in at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(out, pa.binary())], ["doc_id", "lang", "windows"])

    got = pick(known, "lang", counts, per_language).mapInArrow(some, "doc_id long, lang string, windows binary").toArrow().sort_by("doc_id")
    langs = got.column("lang").to_pylist()
    names = sorted(set(langs))
    if not names:
        return None
    x = [np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, WINDOW) for b in got.column("windows")]
    net = ByteConvNet(names)
    net.fit(np.concatenate(x), np.repeat([names.index(v) for v in langs], [len(k) for k in x]))
    del got, x
    release_memory()
    return net


def identify(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, lang_pred string, score double), a row for each row of docs.

    UNKNOWN with score 0 for texts that are null or without a letter, or if there was nothing to learn from.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in it:
            data, offs = arrow_texts(batch.column("text"))
            letters = np.array([bool(t and _LETTER.search(t)) for t in batch.column("text").to_pylist()], bool)
            if model is None:
                letters[:] = False
                best, p = np.zeros(len(letters), int), np.zeros(len(letters))
            else:
                best, p = model.predict(data, offs)
            pred = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.where(letters, p, 0.0))], ["doc_id", "lang_pred", "score"])

    texts = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> (doc_id, held_out boolean, lang_pred, score), a row for each row of docs: learned from docs itself, held-out rows apart.

    Texts that are null or without a letter are UNKNOWN with score 0; held_out is null for a row without doc_id, from
    which nothing is learned. Other columns are ignored, whatever their names.
    """
    found = identify(docs, train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
