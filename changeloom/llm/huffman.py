"""Canonical length-limited Huffman codes of token ids, in numpy.

A block's ids are coded one after the other; a checkpoint gives the bit length of every
SEGMENT ids, so segments decode independently of each other: all of them at once, one id of each
per step, by a table over the next `limit` bits.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 128


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    limit = limit or max(16, int(n - 1).bit_length() + 1)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    by = used[np.argsort(counts[used], kind="stable")]
    weight = counts[by].astype(np.float64)
    # level by level from the longest codes: sorted coins, and how many of the first k are leaves
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        coins = np.concatenate([weight, packages])
        order = np.argsort(coins, kind="stable")
        levels.append(np.cumsum(order < n))
        coins = coins[order]
        even = len(coins) // 2 * 2
        packages = coins[:even:2] + coins[1:even:2]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for leaves in reversed(levels):
        if not take:
            break
        own = int(leaves[take - 1])
        lengths[:own] += 1
        take = 2 * (take - own)
    out[by] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    ls = lengths[order].astype(np.int64)
    if len(order):
        top = int(ls.max())
        # Kraft sums in units of the longest code
        before = np.concatenate([[0], np.cumsum(np.int64(1) << (top - ls))[:-1]])
        codes[order] = (before >> (top - ls)).astype(np.uint32)
    return codes


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.uint8)
        self.codes = canonical_codes(self.lengths)
        self.limit = max(1, int(self.lengths.max(initial=0)))
        if self.limit > 24:
            raise ValueError("codes of over 24 bits")
        self._table = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Coded bits, and the bit length of each segment (uint16)."""
        lens = self.lengths[ids].astype(np.int64)
        if len(ids) and not lens.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ids) else 0
        at = ends - lens
        # each code reaches over at most 4 bytes
        word = self.codes[ids].astype(np.uint64) << (32 - lens - (at & 7)).astype(np.uint64)
        first, size = at >> 3, total // 8 + 4
        raw = np.zeros(size, np.float64)
        for k in range(4):
            part = ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
            raw += np.bincount(first + k, part, size)[:size] if len(ids) else 0
        cuts = np.append(np.arange(0, len(ids), SEGMENT), len(ids))
        bits = np.append(at, total)[cuts]
        return raw[: (total + 7) // 8].astype(np.uint8).tobytes(), np.diff(bits).astype(np.uint16)

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self._table is None:
            sym, ln = np.zeros(1 << self.limit, np.int32), np.zeros(1 << self.limit, np.int64)
            used = np.flatnonzero(self.lengths)
            order = used[np.argsort(self.lengths[used], kind="stable")]
            span = np.int64(1) << (self.limit - self.lengths[order].astype(np.int64))
            n = int(span.sum())
            sym[:n], ln[:n] = np.repeat(order, span), np.repeat(self.lengths[order], span)
            self._table = sym, ln
        return self._table

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """The ids of blocks (bits, segment lengths, number of ids), all segments side by side."""
        sym, ln = self._tables()
        raw = np.frombuffer(b"".join([*(b for b, _, _ in blocks), bytes(8)]), np.uint8).astype(np.int64)
        size = np.array([len(b) for b, _, _ in blocks], np.int64)
        base = (np.cumsum(size) - size) * 8
        at, want = [], []
        for (_, seg, n), start in zip(blocks, base.tolist(), strict=True):
            seg = seg.astype(np.int64)
            at.append(start + np.cumsum(seg) - seg)
            want.append(np.minimum(SEGMENT, n - SEGMENT * np.arange(len(seg))))
        at, want = np.concatenate(at), np.concatenate(want)
        out = np.zeros((SEGMENT, len(at)), np.int32)
        last = len(raw) - 4
        mask, shift = (1 << self.limit) - 1, 32 - self.limit
        for k in range(int(want.max(initial=0))):
            byte = np.minimum(at >> 3, last)
            word = raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]
            code = (word >> (shift - (at & 7))) & mask
            out[k] = sym[code]
            at = at + ln[code]
        flat, res, i = out.T, [], 0
        for _, seg, n in blocks:
            res.append(np.ascontiguousarray(flat[i : i + len(seg)]).ravel()[:n])
            i += len(seg)
        return res
