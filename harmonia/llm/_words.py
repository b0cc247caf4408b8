"""Vectorised word hashing over Arrow string buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.  All work is on
whole byte buffers with numpy, never on one word at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; no result depends on it.
CHUNK = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hash_block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of ``data``; no word runs over a break."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    first[inner] = word[inner]
    at = np.flatnonzero(word)
    if not len(at):
        return at, np.empty(0, np.uint64)
    starts = np.flatnonzero(first)
    heads = np.flatnonzero(first[at])
    lengths = np.diff(np.append(heads, len(at)))
    inside = np.arange(len(at)) - np.repeat(heads, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _STEP, np.uint64))
    return starts, mix(np.add.reduceat(_BYTE[data[at]] * powers[inside], heads))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Cut one long text at white space into pieces of about CHUNK bytes."""
    begin = 0
    while begin < len(data):
        end = min(begin + CHUNK, len(data))
        if end < len(data):
            gap = _SPACE[data[end:]]
            end += int(gap.argmax()) if gap.any() else len(gap)
        yield data[begin:end]
        begin = end


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data, offsets


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for every row of ``texts``."""
    if not len(texts):
        return
    data, offsets = text_buffer(texts)
    row, last = 0, len(offsets) - 1
    while row < last:
        if offsets[row + 1] - offsets[row] > CHUNK:
            own = [_hash_block(p, np.empty(0, np.int64))[1] for p in _pieces(data[offsets[row] : offsets[row + 1]])]
            yield row, np.concatenate(own)
            row += 1
            continue
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        stop = min(stop, last)
        breaks = offsets[row : stop + 1] - offsets[row]
        starts, hashes = _hash_block(data[offsets[row] : offsets[stop]], breaks)
        cuts = np.searchsorted(starts, breaks)
        for k in range(stop - row):
            yield row + k, hashes[cuts[k] : cuts[k + 1]]
        row = stop


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _SHINGLE[k]
    return np.unique(mix(total + np.uint64(n)))
