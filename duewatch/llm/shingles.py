"""Word shingles of whole texts as sorted 64-bit hashes, computed with numpy over an Arrow column's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Fixed odd constants: the base of the word polynomial, and a multiplier for each place in a shingle.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACES = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64
)
#: Bytes hashed at a time; only bounds memory.
CHUNK_BYTES = 1 << 19
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> list[np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(
    data: np.ndarray, ends: np.ndarray, letters: np.ndarray = LOWER, gaps: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words of each text; ``ends`` are the texts' ends in ``data``.

    ``letters`` maps bytes before hashing, ``gaps`` marks the bytes between words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    solid = ~gaps[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = ends[:-1][ends[:-1] < n]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = ends[(ends > 0)] - 1
    last[cuts] = solid[cuts]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((letters[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    at = np.searchsorted(start, ends)
    return words, np.diff(at, prepend=0)


def text_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes and text ends of successive runs of rows, nulls as empty texts."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield data[offsets[low] : offsets[high]], offsets[low + 1 : high + 1] - offsets[low], low, high
        low = high


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For successive runs of rows: distinct shingle hashes, sorted within each text, and their number for each text.

    A text with fewer than ``width`` words has its whole sequence as one shingle; one without words, or null, has none.
    """
    places = PLACES[:width]
    for data, ends, _, _ in text_chunks(column):
        words, counts = word_hashes(data, ends)
        runs = np.zeros(max(1, len(words) - width + 1), np.uint64)
        for k in range(width if len(words) >= width else 0):
            runs += words[k : len(words) - width + 1 + k] * places[k]
        runs = mix(runs + np.uint64(width))
        begin = np.cumsum(counts) - counts
        sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        stop = np.cumsum(sizes)
        at = np.arange(stop[-1]) + np.repeat(begin - (stop - sizes), sizes)
        tokens = runs[np.minimum(at, len(runs) - 1)]
        for row in np.flatnonzero((counts > 0) & (counts < width)).tolist():
            few = words[begin[row] : begin[row] + counts[row]]
            whole = (few * places[: len(few)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(few))
            tokens[stop[row] - 1] = mix(whole)[0]
        for low, high in zip((stop - sizes).tolist(), stop.tolist(), strict=True):
            tokens[low:high].sort()
        keep = np.ones(len(tokens), bool)
        keep[1:] = tokens[1:] != tokens[:-1]
        keep[(stop - sizes)[sizes > 0]] = True
        total = np.concatenate([[0], np.cumsum(keep)])
        yield tokens[keep], total[stop] - total[stop - sizes]


def fingerprints(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each set that name it, whatever its order."""
    out = np.zeros((len(counts), 2), np.uint64)
    some = counts > 0
    if some.any():
        at = (np.cumsum(counts) - counts)[some]
        out[some, 0] = np.add.reduceat(mix(tokens ^ np.uint64(0x243F6A8885A308D3)), at)
        out[some, 1] = np.add.reduceat(mix(tokens + np.uint64(0x13198A2E03707344)), at)
    return out
