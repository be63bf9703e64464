"""Word positions, word hashes and shingle hashes of an Arrow string batch.

A word is a maximal run of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``).  Everything works on the UTF-8 bytes of a batch
with numpy, in pieces of a few MB cut at white space, so that the memory in
use does not depend on the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix64(steps + np.uint64(seed)) | np.uint64(1)


_BYTE = _constants(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWER = _constants(1, 12)[0]
_SLOT = _constants(64, 13)


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has no bytes."""
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)
            or pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.string())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if "binary" in str(col.type) else "")
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32, n + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8, int(o[-1] - o[0]), int(o[0])), o - o[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE_BYTES):
    """(from, to) byte ranges that cover ``data``, cut at white space or at the start of a text."""
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + size)
        if b < n:
            k = np.searchsorted(offsets, b)
            edge = int(offsets[k]) if k < len(offsets) else n
            at, step = b, 1 << 12
            while at < edge:
                hit = _SPACE[data[at:min(edge, at + step)]]
                if hit.any():
                    at += int(hit.argmax())
                    break
                at = min(edge, at + step)
            b = max(at, a + 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Start (byte position in ``data``) and 64-bit hash of every word; ``fold`` reads A-Z as a-z."""
    starts, hashes = [], []
    table = _FOLDED if fold else _BYTE
    for a, b in pieces(data, offsets):
        s, e = _spans(data, offsets, a, b)
        if not len(s):
            continue
        length = e - s
        powers = np.multiply.accumulate(np.full(int(length.max()), _POWER, np.uint64))
        total = int(length.sum())
        first = np.cumsum(length) - length
        inside = np.arange(total) - np.repeat(first, length)
        values = table[data[np.repeat(s, length) + inside]] * powers[inside]
        starts.append(s)
        hashes.append(mix64(np.add.reduceat(values, first) + length.astype(np.uint64)))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def _spans(data: np.ndarray, offsets: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words between bytes ``a`` and ``b`` of ``data``."""
    word = ~_SPACE[data[a:b]]
    head = word.copy()
    head[1:] &= ~word[:-1]
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    at = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
    at = at[(at >= 0) & (at < b - a)]
    head[at] = word[at]
    before = at[at > 0] - 1
    tail[before] = word[before]
    return np.flatnonzero(head) + a, np.flatnonzero(tail) + a + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of the batch."""
    parts = [_spans(data, offsets, a, b) for a, b in pieces(data, offsets)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from every place of ``words`` (word hashes) on; places too near the end have none."""
    n = max(len(words) - width + 1, 0)
    acc = np.full(n, np.uint64((width * 0xD1342543DE82EF95) & _MASK), np.uint64)
    for j in range(width):
        acc += words[j:n + j] * _SLOT[j % 64] * np.uint64(2 * (j // 64) + 1)
    return mix64(acc)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word windows of one text's word
    hashes; a shorter text is one window, a text without words has none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(len(words), size)))


def row_slices(batch: pa.RecordBatch, column: str, size: int = 8 << 20):
    """Consecutive slices of ``batch`` whose ``column`` holds about ``size`` bytes at most (one row at least)."""
    if batch.num_rows == 0:
        return
    _, offsets = string_buffers(batch.column(batch.schema.get_field_index(column)))
    a = 0
    while a < batch.num_rows:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(max(b, a + 1), batch.num_rows)
        yield batch.slice(a, b - a)
        a = b
