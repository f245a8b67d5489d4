"""BPE encoding in batched numpy merge rounds, and decoding.

The file is a `tokenizers` JSON of the word-BPE kind: NFC, white space to a space, lower case, a
Split pattern, byte-level symbols with an end-of-word suffix. Distinct words are encoded together:
their symbols lie in one flat array; each round looks up all neighbouring pairs by binary search
over the sorted pair keys, finds every word's lowest rank and merges all its occurrences, from the
left. Words that have no pair left drop out.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .piececache import PieceCache
from .storage import bound_batches, tidy
from .textbytes import arrow_texts, chunks

LONG_WORD = 2048  #: symbols; longer words are merged with a heap, one by one
CACHED_PIECES = 400_000
RUN_BYTES = 1 << 20  #: of text that are encoded together
_NONE = np.iinfo(np.int32).max
#: White space of the Split pattern (Unicode's White_Space property).
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Letters and numbers (first, last) that `regex` knows and Unicode 16 does not.
_NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9),
    (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED),
    (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
#: Lower case of the letters that came after Unicode 15.1.
_NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies have them: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def _word_pattern(pattern: str) -> regex.Pattern:
    """The Split pattern with the white space, letters and numbers of Unicode 16."""
    extra = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in _NEWER)
    pattern = pattern.replace("[^\\s\\p{L}\\p{N}]", f"(?:[^{_SPACE}\\p{{L}}\\p{{N}}]|[{extra}])")
    pattern = pattern.replace("[\\p{L}]", f"[\\p{{L}}--[{extra}]]").replace("[\\p{N}]", f"[\\p{{N}}--[{extra}]]")
    return regex.compile(pattern, regex.V1)


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        symbols = _byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        # as in a map that is filled in order, the last of equal pairs counts
        self.keys, at = np.unique(keys[::-1], return_index=True)
        self.rank = (len(keys) - 1 - at).astype(np.int32)
        self.made = np.array([vocab[a + b[:]] for a, b in pairs], np.int32)[self.rank]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"added token {t['content']!r} is of a kind that is not supported")
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        blobs = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.text = np.frombuffer(b"".join(blobs), np.uint8)
        self.text_len = np.array([len(b) for b in blobs], np.int64)
        self.text_at = np.cumsum(self.text_len) - self.text_len
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = _word_pattern(splits[0])
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache = PieceCache(self._pieces, CACHED_PIECES)

    # --- words

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, flat, and the number of ids of each."""
        lens = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lens)
        sym = self.first[raw]
        sym[ends[lens > 0] - 1] = self.last[raw[ends[lens > 0] - 1]]
        word = np.repeat(np.arange(len(words)), lens)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.flatnonzero(lens > LONG_WORD).tolist():
            ids = np.array(self._heap(sym[ends[w] - lens[w] : ends[w]].tolist()), np.int32)
            done.append((np.full(len(ids), w), ids))
        keep = (lens <= LONG_WORD)[word]
        sym, word = sym[keep], word[keep]
        while len(sym) > 1:
            key = (sym[:-1].astype(np.int64) << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (word[1:] == word[:-1]), self.rank[at], _NONE)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(np.append(rank, _NONE), heads)
            size = np.diff(np.append(heads, len(sym)))
            low = np.repeat(least, size)
            hit = (rank == low[:-1]) & (rank != _NONE)
            # of neighbouring hits (equal symbols) every other one, from the left
            pos = np.flatnonzero(hit)
            if len(pos):
                run = np.flatnonzero(np.concatenate([[True], np.diff(pos) > 1]))
                nth = np.arange(len(pos)) - np.repeat(run, np.diff(np.append(run, len(pos))))
                pos = pos[nth % 2 == 0]
                sym[pos] = self.made[at[pos]]
            live = np.ones(len(sym), bool)
            live[pos + 1] = False
            over = np.repeat(least == _NONE, size)
            if over.any():
                done.append((word[over], sym[over]))
                live &= ~over
            sym, word = sym[live], word[live]
        if len(sym):
            done.append((word, sym))
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _heap(self, sym: list[int]) -> list[int]:
        """The merges of one long word, lowest rank first, then leftmost."""
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist(), strict=True), strict=True))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and (m := self._pairs.get(sym[i] << 32 | sym[j])):
                heapq.heappush(heap, (m[0], i, sym[i], sym[j], m[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [s for s in sym if s >= 0]

    # --- texts

    def _split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        if low and max(low) > "\u1c88":
            low = low.translate(_NEW_LOWER)
        return self.words.findall(low)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces of text; special tokens are found before anything else."""
        parts: list[list[str | int]] = []
        for p in pieces:
            if self.specials and "<" in p and self.specials.search(p):
                mine, at = [], 0
                for m in self.specials.finditer(p):
                    mine += [*self._split(p[at : m.start()]), self.special[m[0]]]
                    at = m.end()
                parts.append(mine + self._split(p[at:]))
            else:
                parts.append(self._split(p))
        words = {w: k for k, w in enumerate({w for x in parts for w in x if isinstance(w, str)})}
        flat, count = self.merge_words([w.encode() for w in words])
        for w, i in self.special.items():  # one more word each
            words[i] = len(words)
            flat, count = np.append(flat, np.int32(i)), np.append(count, 1)
        start = np.cumsum(count) - count
        n = np.array([len(x) for x in parts], np.int64)
        at = np.fromiter((words[w] for x in parts for w in x), np.int64, int(n.sum()))
        lens = count[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        out = flat[np.repeat(start[at] - ends[:-1], lens) + np.arange(ends[-1])]
        cuts = ends[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
        return out, np.diff(cuts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, flat, and n + 1 offsets."""
        return self.cache.ids(*arrow_texts(pa.array(texts, pa.string())))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each text's tokens, joined by a space."""
        lens = self.text_len[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        raw = self.text[np.repeat(self.text_at[ids] - ends[:-1], lens) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets].tolist()
        return [raw[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> the columns `keep` (doc_id), ids array<int>, decoded string.

    A row for each row of docs. Null counts as an empty text, which has no ids and decodes to an
    empty text. `path` is the tokenizer's JSON, which every worker reads from its own installation.
    """
    keep = ["doc_id"] if keep is None else keep
    kind = T.StructType([docs.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in it:
            for i, part, po in chunks(*arrow_texts(batch.column("__text")), RUN_BYTES):
                ids, offs = bpe.cache.ids(part, po)
                decoded = bpe.decode(ids, offs)
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
                cols = [batch.column(c).slice(i, len(po) - 1) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, lists, pa.array(decoded, pa.binary()).cast(pa.string())], [*keep, "ids", "decoded"])

    return bound_batches(docs).select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(tidy(run), kind)
