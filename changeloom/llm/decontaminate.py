"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The benchmark is small beside the corpus. Its automaton goes to the workers once; one of more than
MAX_ITEM_WORDS is cut between items into several automata, which are scanned for one after the other,
with each document's hits so far written beside it and merged at the end. Each document's words are streamed through it, which gives the length of the
longest match that ends at every word. A word is hit if it lies inside an occurrence of a window:
WINDOW consecutive words of an item, or the whole of a shorter item. Words outside the benchmark's
vocabulary end every match, so only runs of known words of at least the shortest window are streamed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Workspace, bound_batches, fresh_name, tidy
from .textbytes import LOWER, NON_ALNUM, arrow_texts, chunks, span_hashes, word_spans

WINDOW = 8
MAX_ITEM_WORDS = 1_000_000  #: of one automaton, at 8 characters a word; a longer item has one of its own


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences, with what ends at each state.

    windows[s]: the indices of items with a full window that a match in state s of at least `window`
    words ends with; short[s]: (length, item) of shorter items that are suffixes of the state's words.
    """

    def __init__(self, items: Iterable[tuple[int, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int]] = []
        whole: list[tuple[int, int, int]] = []
        for item, words in items:
            last = 0
            for k, w in enumerate(words):
                last = self._extend(last, w)
                if k + 1 >= window:
                    ends.append((last, item))
            if 0 < len(words) < window:
                whole.append((last, len(words), item))
        # the state on the suffix path that holds the suffix of exactly `window` words
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.at_window = [-1] * len(self.link)
        for s in order:
            if self.length[s] >= window:
                up = self.link[s]
                self.at_window[s] = s if self.length[up] < window else self.at_window[up]
        found: dict[int, set[int]] = {}
        for s, item in ends:
            found.setdefault(self.at_window[s], set()).add(item)
        self.windows = {s: tuple(sorted(v)) for s, v in found.items()}
        own: dict[int, list[tuple[int, int]]] = {}
        for s, n, item in whole:
            own.setdefault(s, []).append((n, item))
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        for s in order[1:]:
            all_ = (*self.short.get(self.link[s], ()), *own.get(s, ()))
            if all_:
                self.short[s] = all_

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the shorter words that p leads to."""
        clone = self._state(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # these words are known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def scan(self, words: list[int]) -> Iterator[tuple[int, int, tuple[int, ...], int]]:
        """(position of the last word, words covered, items) for each occurrence of a window; the longest match there."""
        s = n = 0
        nexts, window = self.next, self.window
        for i, w in enumerate(words):
            t = nexts[s].get(w)
            while t is None and s:
                s = self.link[s]
                n = self.length[s]
                t = nexts[s].get(w)
            if t is None:
                continue
            s, n = t, n + 1
            if n >= window:
                yield i, window, self.windows[self.at_window[s]], n
            for m, item in self.short.get(s, ()):
                if m <= n:
                    yield i, m, (item,), n


#: From a word to the one after the last, from a byte to the one after the last.
Span = tuple[int, int, int, int]


def merge_spans(spans: Iterable[Span]) -> list[Span]:
    """Spans in order; those that overlap or touch are one."""
    out: list[Span] = []
    for x, y, a, b in sorted(spans):
        if out and out[-1][1] >= x:
            u, v, c, d = out[-1]
            out[-1] = u, max(v, y), c, max(d, b)
        else:
            out.append((x, y, a, b))
    return out


class Benchmark:
    """The automaton, the vocabulary (word hash -> id) and the item names."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int = WINDOW):
        rows = sorted(rows, key=lambda r: (r[0], r[1] or ""))
        self.names = sorted({r[0] for r in rows})
        number = {n: k for k, n in enumerate(self.names)}
        texts = pa.array([r[1] for r in rows], pa.string())
        data, offs = arrow_texts(texts)
        low = LOWER[data]
        starts, ends, first = word_spans(low, offs, NON_ALNUM)
        self.vocabulary, ids = np.unique(span_hashes(low, starts, ends), return_inverse=True)
        cuts = [(int(a), int(b)) for a, b in zip(first[:-1], first[1:], strict=True)]
        self.shortest = min([min(window, b - a) for a, b in cuts if b > a], default=window)
        self.automaton = SuffixAutomaton(((number[r[0]], ids[a:b].tolist()) for r, (a, b) in zip(rows, cuts, strict=True)), window)

    def matches(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, set[int], list[Span], int]]:
        """For each text: words, items found, hit spans, longest match in words."""
        for _, part, po in chunks(data, offs):
            low = LOWER[part]
            starts, ends, first = word_spans(low, po, NON_ALNUM)
            n = len(starts)
            runs_a = runs_b = np.zeros(0, np.int64)
            if n and len(self.vocabulary):
                h = span_hashes(low, starts, ends)
                ids = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
                known = np.zeros(n + 1, bool)
                known[:n] = self.vocabulary[ids] == h
                begins = known[:n].copy()
                begins[1:] &= ~known[: n - 1]
                inner = first[(first > 0) & (first < n)]
                begins[inner] = known[inner]
                runs_a = np.flatnonzero(begins)
                # a run ends before the next unknown word or the next run
                stop = np.flatnonzero(~known)
                runs_b = np.minimum(stop[np.searchsorted(stop, runs_a)], np.append(runs_a[1:], n))
                long = runs_b - runs_a >= self.shortest
                runs_a, runs_b = runs_a[long], runs_b[long]
            at = np.searchsorted(runs_a, first)
            for d in range(len(po) - 1):
                items: set[int] = set()
                spans: list[list[int]] = []
                longest = 0
                for a, b in zip(runs_a[at[d] : at[d + 1]].tolist(), runs_b[at[d] : at[d + 1]].tolist(), strict=True):
                    for i, m, found, whole in self.automaton.scan(ids[a:b].tolist()):
                        items.update(found)
                        longest = max(longest, whole)
                        x, y = a + i - m + 1, a + i + 1
                        while spans and spans[-1][1] >= x:  # ends never decrease
                            x = min(x, spans.pop()[0])
                        spans.append([x, y])
                base, zero = int(po[d]), int(first[d])
                yield int(first[d + 1]) - zero, items, [(x - zero, y - zero, int(starts[x]) - base, int(ends[y - 1]) - base) for x, y in spans], longest


#: Characters that a row of the benchmark counts for beside its text, so that the number of rows is bounded too.
ROW_CHARS = 8


def item_parts(items: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """items (item_id, text, ...) as lists of (name, text) for one automaton each, at least one; null and empty texts have no words and are left out, rows that repeat an item_id are one item, one without item_id is named ''."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    most = 8 * MAX_ITEM_WORDS
    if (rows.agg(F.sum(F.length("text") + ROW_CHARS)).first()[0] or 0) <= most:
        yield [(r[0], r[1]) for r in rows.collect()]
        return
    part, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r[1]) + ROW_CHARS
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += n
    yield part


HITS_TYPE = "struct<items:array<string>,spans:array<struct<x:int,y:int,a:long,b:long>>,longest:long>"


def _hits(bench: Benchmark, batch: pa.RecordBatch, earlier: str) -> Iterator[tuple[int, set[str], list[Span], int]]:
    """For each text: words, names of items, hit spans, longest match; with the hits of earlier automata, if the batch has that column."""
    data, offs = arrow_texts(batch.column("text"))
    before = batch.column(earlier) if earlier in batch.schema.names else None
    for i, (words, found, spans, longest) in enumerate(bench.matches(data, offs)):
        names = {bench.names[k] for k in found}
        old = before[i].as_py() if before is not None else None
        if old:
            names.update(old["items"])
            spans = merge_spans([*spans, *((p["x"], p["y"], p["a"], p["b"]) for p in old["spans"])])
            longest = max(longest, old["longest"])
        yield words, names, spans, longest


def _scanned(docs: DataFrame, items: DataFrame, window: int):
    """docs with the hits of all automata but the last in a column of a name that docs has not (none if there is one automaton only), the last one, broadcast, and that name."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    names, earlier = docs.columns, fresh_name(docs.columns, "__hits")
    kind = T.StructType([*docs.schema.fields, T.StructField(earlier, T._parse_datatype_string(HITS_TYPE))])
    hits = to_arrow_schema(kind).field(earlier).type
    parts = item_parts(items)
    part, work = next(parts), None
    for k, following in enumerate(parts):
        work = work or Workspace(spark, "decontaminate")
        held = spark.sparkContext.broadcast(Benchmark(part, window))

        def run(it, held=held):
            bench = held.value
            for batch in it:
                rows = [{"items": sorted(n), "spans": [dict(zip("xyab", s, strict=True)) for s in spans], "longest": m} if n else None for _, n, spans, m in _hits(bench, batch, earlier)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rows, hits)], [*names, earlier])

        docs = work.write(bound_batches(docs).mapInArrow(tidy(run), kind), f"part-{k}")
        held.destroy()
        if k:
            work.drop(f"part-{k - 1}")
        part = following
    return docs, spark.sparkContext.broadcast(Benchmark(part, window)), earlier


FOUND = "doc_id long, n_words long, n_hit long, longest long, item_ids array<string>, spans array<struct<first:long,last:long>>"


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, ...) -> FOUND: words, hit words, longest match, items found (sorted), hit spans in UTF-8 bytes.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. Null and empty texts
    have no words; a row for each row of docs, repeated ones too. Other columns are ignored.
    """
    docs, held, earlier = _scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items, window)
    kind = T._parse_datatype_string(FOUND)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)

    def run(it):
        bench = held.value
        for batch in it:
            out = [(w, sum(y - x for x, y, _, _ in spans), n, sorted(names), [{"first": a, "last": b} for _, _, a, b in spans]) for w, names, spans, n in _hits(bench, batch, earlier)]
            cols = [batch.column("doc_id"), *(pa.array([o[k] for o in out], schema.field(k + 1).type) for k in range(5))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return bound_batches(docs).mapInArrow(run, kind)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_items: int = 1, coverage: float = 0.5, most_words: int | None = None) -> DataFrame:
    """docs without contaminated rows, and without the hit spans of the others; the same columns.

    A row goes if more than `most_items` items occur in it, if over `coverage` of its words are hit,
    or if a match is longer than `most_words`. Of the rest, hit spans are cut out of the text and
    n_chars (if there) is set anew; rows without hits, null and empty texts among them, are passed on as they
    are, as are rows that repeat a doc_id or have none. Other columns are kept, whatever their names.
    """
    names, kind = docs.columns, docs.schema
    docs, held, earlier = _scanned(docs, items, window)

    def run(it):
        bench = held.value
        for batch in it:
            data, offs = arrow_texts(batch.column("text"))
            keep, new = [], {}
            for i, (words, found, spans, longest) in enumerate(_hits(bench, batch, earlier)):
                hit = sum(y - x for x, y, _, _ in spans)
                keep.append(len(found) <= most_items and hit <= coverage * words and not (most_words and longest > most_words))
                if spans and keep[-1]:
                    raw, at, parts = data[offs[i] : offs[i + 1]].tobytes(), 0, []
                    for _, _, a, b in spans:
                        parts.append(raw[at:a])
                        at = b
                    new[i] = b"".join([*parts, raw[at:]]).decode()
            cols = []
            for name in names:
                col = batch.column(name)
                if new and name in ("text", "n_chars"):
                    vals = col.to_pylist()
                    for i, t in new.items():
                        vals[i] = t if name == "text" else len(t)
                    col = pa.array(vals, col.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    return bound_batches(docs).mapInArrow(tidy(run), kind)
