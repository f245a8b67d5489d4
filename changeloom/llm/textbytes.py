"""Whole texts as flat byte arrays: word spans and 64-bit hashes in numpy.

A batch of texts is one uint8 array with document offsets. Everything here works on
UTF-8 bytes, never splits a document and never looks past its end; batches are cut into
chunks of half a MB so that temporaries stay small whatever the Arrow batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  #: temporaries take up to about a hundred times as many and should stay near the caches
KEPT_POWERS = 1 << 24
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}

#: Bytes that end a word: white space (0x20, 0x09-0x0D).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word: every ASCII byte but digits and letters.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x41:0x5B] = False
NON_ALNUM[0x61:0x7B] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser; a bijection on uint64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.full(max(n, CHUNK_BYTES + 1), _BASE if which == "up" else _BASE_INV, np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if len(have) <= KEPT_POWERS:
            _powers[which] = have
    return have[:n]


def arrow_texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # more than one chunk is left only beyond 2 GB
        column = pa.concat_arrays([c.cast(pa.large_string()) for c in column.chunks])
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, offsets) of runs of whole documents of about `size` bytes; a longer document is a run of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes; index of each document's first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    before[inner] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, equal for equal bytes wherever they stand."""
    n = len(data)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum(_LETTERS[data] * _power("up", n), out=run[1:])
    return mix((run[ends] - run[starts]) * _power("down", n + 1)[starts] + (ends - starts).astype(np.uint64))


_ROLE = mix(np.arange(1, 65, dtype=np.uint64)) | _U(1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i : i + width] for every i; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n] * _ROLE[0]
    for k in range(1, width):
        h = h + words[k : k + n] * _ROLE[k]
    return mix(h)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its word shingles (words end at white space, A-Z in lower case).

    With fewer words than `width` the whole sequence is one shingle; without words the set is empty.
    """
    for _, part, po in chunks(data, offs):
        low = LOWER[part]
        starts, ends, first = word_spans(low, po, SPACE)
        words = span_hashes(low, starts, ends)
        grams = shingle_hashes(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                g = np.sort(grams[a : b - width + 1])
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                yield g[keep]
            elif b > a:
                yield mix((words[a:b] * _ROLE[: b - a]).sum(keepdims=True) + _U(b - a))
            else:
                yield np.zeros(0, np.uint64)


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit id of a set of hashes (sorted, distinct)."""
    if not len(tokens):
        return 0
    return int(mix(mix(tokens ^ _U(0xD6E8FEB86659FD93)).sum(keepdims=True) + _U(len(tokens))).view(np.int64)[0])
