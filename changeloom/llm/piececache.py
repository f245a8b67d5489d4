"""Token ids of whole texts by way of their distinct pieces, found by 64-bit hashes in numpy.

For tokenizers that lower-case, drop white space and never put letters or digits into one
pre-token with punctuation, a text's ids are those of its pieces, one after the other. Pieces end at
spaces and line feeds, and before punctuation (ASCII) that ends such a piece behind an ASCII letter
or digit or a Latin-1 letter. A-Z are put in lower case first, unless a special token or a combining
mark could be concerned. A piece is never part of a character or of a special token.

Each worker keeps the ids of the pieces it has met in flat arrays, sorted by hash; only pieces not met
before become strings. The cache has a size bound and starts anew beyond it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textbytes import LOWER, span_hashes, word_spans

MOST_PIECES = 2_000_000
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Second bytes of the Latin-1 letters U+00C0 to U+00FF; 0x97 and 0xB7 are signs.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def piece_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces, and each text's first piece."""
    starts, ends, first = word_spans(data, offs, _BREAK)
    if not len(starts):
        return starts, ends, first
    # where the punctuation at the end of a piece begins: behind its last other byte
    other = np.flatnonzero(~_PUNCT[data])
    at = np.searchsorted(other, ends - 1, "right") - 1
    last = np.where(at >= 0, other[np.maximum(at, 0)], -1)
    has = (last >= starts) & (last < ends - 1)
    cut = np.minimum(last + 1, len(data) - 1)
    here, before = data[np.maximum(last, 0)], data[np.maximum(last - 1, 0)]
    has &= (_ALNUM[here] | ((before == 0xC3) & (last - 1 >= starts) & _LATIN[here])) & (data[cut] != 0x7C)
    cut = cut[has]
    new = np.concatenate([starts, cut])
    order = np.argsort(new, kind="stable")
    head_ends = ends.copy()
    head_ends[has] = cut
    all_ends = np.concatenate([head_ends, ends[has]])[order]
    starts = new[order]
    return starts, all_ends, np.searchsorted(starts, offs)


class PieceCache:
    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = MOST_PIECES):
        """encode: distinct pieces -> their ids, flat, and the number of ids of each; most: pieces that are kept."""
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        flat, count = self.encode([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(flat), np.int32)])
        self.flat[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(count) - count
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.count = (np.insert(x, at, y) for x, y in ((self.keys, keys), (self.start, start), (self.count, count)))

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and n + 1 offsets."""
        raw = data.tobytes()
        if b"<|" not in raw and not ((data == 0xCC) | (data == 0xCD)).any():
            data = LOWER[data]
        starts, ends, first = piece_spans(data, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        keys, some, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            if len(self.keys) + len(keys) > self.most:
                self._clear()
                known[:] = False
            new = ~known
            self._learn(data, keys[new], starts[some[new]], ends[some[new]])
            at = np.searchsorted(self.keys, keys)
        at = at[inverse]
        lens = self.count[at]
        cuts = np.concatenate([[0], np.cumsum(lens)])
        return self.flat[np.repeat(self.start[at] - cuts[:-1], lens) + np.arange(cuts[-1])], cuts[first]

