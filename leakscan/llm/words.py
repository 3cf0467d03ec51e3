"""Words and word shingles of whole texts as 64-bit hashes, over Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D with A-Z lower-cased. A text of fewer than
k words is one shingle, its whole word sequence; a null, empty or blank text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_BYTE = np.arange(256)
SOLID = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))
_VALUE = constants(256, 1)[np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)]
_PLACE = constants(64, 2)
_BASE = constants(1, 3)[0]
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 256), _BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def parts(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about limit bytes (a longer text is alone): first row, end row, bytes, offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, o, d = texts.buffers()
    offs = np.frombuffer(o, np.int64, n + 1 + texts.offset)[texts.offset :]
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and where each text's words begin (one more entry than texts)."""
    solid = SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offs[:-1][offs[:-1] < len(data)]
    first[inner] = solid[inner]
    at = np.flatnonzero(first)
    woffs = np.searchsorted(at, offs)
    if not len(at):
        return np.zeros(0, np.uint64), woffs
    count = np.cumsum(solid)
    begin = count[at] - 1
    lens = np.diff(np.append(begin, count[-1]))
    place = np.arange(int(count[-1])) - np.repeat(begin, lens)
    h = np.add.reduceat(_VALUE[data[solid]] * powers(int(lens.max()))[place], begin)
    return mix(h + lens.astype(np.uint64) * _PLACE[63]), woffs


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions whose k words run past the end are cut off."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : n + j] * _PLACE[j]
    return mix(h)


def short_hash(words: np.ndarray, k: int) -> np.ndarray:
    """The one shingle of a text with fewer than k words."""
    n = len(words)
    return mix((words * _PLACE[:n]).sum(keepdims=True) + _PLACE[62:63] * np.uint64(n)) if n else np.zeros(0, np.uint64)


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    for _, _, data, offs in parts(texts):
        words, woffs = word_hashes(data, offs)
        sh = shingle_hashes(words, k)
        for s, e in zip(woffs[:-1].tolist(), woffs[1:].tolist(), strict=True):
            yield distinct(sh[s : e - k + 1] if e - s >= k else short_hash(words[s:e], k))


def lists(sets: list[np.ndarray]) -> pa.Array:
    """Arrays of unsigned hashes as an Arrow column of signed lists."""
    offs = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int64()))
