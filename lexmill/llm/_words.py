"""Vectorised hashing of the words of many texts at once.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts are read
as the contiguous UTF-8 buffer of an Arrow string column, never one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once, also of a longer word; bounds the working arrays to some 20 MB.
CHUNK = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 256), _BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.multiply.accumulate(table)
    return _powers


def _hash_chunk(buf: np.ndarray, opens: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start offsets and hashes of the words of ``buf``; ``opens`` marks where a text begins.

    The first array hashes whole words; one more for each length in ``heads``
    hashes the first so many bytes of each word.
    """
    word = ~_SPACE[buf]
    starts_here = word.copy()
    starts_here[1:] &= ~word[:-1] | opens[1:]
    starts = np.flatnonzero(starts_here)
    if not len(starts):
        return starts, [np.zeros(0, dtype=np.uint64) for _ in range(1 + len(heads))]
    at = np.cumsum(starts_here) - 1
    at[at < 0] = 0
    pos = np.arange(len(buf)) - starts[at]
    pos[pos < 0] = 0
    longest = int(pos.max()) + 1
    terms = (buf.astype(np.uint64) + np.uint64(1)) * _power_table(longest)[pos]
    terms[~word] = 0
    out = [mix(np.add.reduceat(terms, starts))]
    for n in heads:
        terms[pos >= n] = 0
        out.append(mix(np.add.reduceat(terms, starts) + np.uint64(n)))
    return starts, out


def _hash_long(buf: np.ndarray, lo: int, end: int, lower: bool, heads: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the one word ``buf[lo:end]``, a chunk at a time: the same as those of :func:`_hash_chunk`."""
    table, base, whole = _power_table(CHUNK)[:CHUNK], int(_BASE), 0
    firsts = [0] * len(heads)
    for at in range(lo, end, CHUNK):
        piece = buf[at : min(at + CHUNK, end)]
        terms = ((_LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)) * table[: len(piece)]
        scale = pow(base, at - lo, 1 << 64)
        whole += int(terms.sum(dtype=np.uint64)) * scale
        for k, n in enumerate(heads):
            if at - lo < n:
                firsts[k] += int(terms[: n - (at - lo)].sum(dtype=np.uint64)) * scale
    fold = lambda x: np.array([x % (1 << 64)], dtype=np.uint64)
    return [mix(fold(whole)), *[mix(fold(x + n)) for x, n in zip(firsts, heads, strict=True)]]


def _chunk_end(buf: np.ndarray, lo: int, offsets: np.ndarray) -> tuple[int, bool]:
    """Where a chunk that starts at ``lo`` ends, and whether it is all of one longer word.

    No word is cut: the chunk ends at a space or where a text does.
    """
    size, hi = len(buf), lo + CHUNK
    if hi >= size:
        return size, False
    text_end = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])  # the last one at or before hi
    spaces = np.flatnonzero(_SPACE[buf[lo : hi + 1]])
    cut = max(text_end, lo + int(spaces[-1]) if len(spaces) else lo)
    if cut > lo:
        return cut, False
    if len(spaces):  # the space at lo alone, then a longer word
        return lo + 1, False
    stop = min(size, int(offsets[np.searchsorted(offsets, lo, side="right")]))
    while hi < stop:
        ahead = np.flatnonzero(_SPACE[buf[hi : min(hi + CHUNK, stop)]])
        if len(ahead):
            return hi + int(ahead[0]), True
        hi += CHUNK
    return stop, True


def hash_words(texts: pa.Array, lower: bool = True, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of all words of an Arrow string array, null read as empty.

    Returns word offsets by text (one more than texts) and, first, the array of
    whole-word hashes, then one for each entry of ``heads``, longest first.
    """
    heads = tuple(sorted(heads, reverse=True))
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, dtype=np.int64)
    body = texts.buffers()[2] if n else None
    buf = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    size = len(buf)
    all_starts, parts, lo = [], [], 0
    while lo < size:
        hi, one_word = _chunk_end(buf, lo, offsets)
        if one_word:
            all_starts.append(np.array([lo]))
            parts.append(_hash_long(buf, lo, hi, lower, heads))
            lo = hi
            continue
        piece = buf[lo:hi]
        opens = np.zeros(hi - lo, dtype=bool)
        inside = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)]
        opens[inside - lo] = True
        starts, hashes = _hash_chunk(_LOWER[piece] if lower else piece, opens, heads)
        all_starts.append(starts + lo)
        parts.append(hashes)
        lo = hi
    if not parts:
        return np.zeros(n + 1, dtype=np.int64), [np.zeros(0, dtype=np.uint64) for _ in range(1 + len(heads))]
    bounds = np.searchsorted(np.concatenate(all_starts), offsets)
    return bounds, [np.concatenate(x) for x in zip(*parts, strict=True)]


def text_slices(texts: pa.Array, most: int = CHUNK) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return slices(np.concatenate(([0], np.cumsum(sizes))), most)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of items whose sizes (differences of ``offsets``) sum to about ``most``, one item at least."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out


def shingles(bounds: np.ndarray, words: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words of each text; a shorter text is one run.

    Returns offsets by text and the hashes, repeats included.
    """
    counts = np.diff(bounds)
    mult = np.uint64(0xD6E8FEB86659FD93)
    if len(words) >= width:
        m = len(words) - width + 1
        run = np.zeros(m, dtype=np.uint64)
        for j in range(width):
            run = run * mult + words[j : j + m]
        run = mix(run)
    else:
        run = np.zeros(0, dtype=np.uint64)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    keep = np.zeros(len(run), dtype=bool)
    long = counts >= width
    if len(run):
        edge = np.zeros(len(run) + 1, dtype=np.int64)
        np.add.at(edge, bounds[:-1][long], 1)
        np.add.at(edge, bounds[1:][long] - width + 1, -1)
        keep = np.cumsum(edge[:-1]) > 0
    out = np.empty(int(offsets[-1]), dtype=np.uint64)
    whole = np.ones(len(out), dtype=bool)
    for i in np.flatnonzero((counts > 0) & ~long):
        h = counts[i : i + 1].astype(np.uint64)
        for j in range(bounds[i], bounds[i + 1]):
            h = h * mult + words[j : j + 1]
        out[offsets[i]] = mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))[0]
        whole[offsets[i]] = False
    out[whole] = run[keep]
    return offsets, out
