"""Words and shingles as numpy arrays, shared by the operators that run in Python.

A word is a maximal run of characters other than the six ASCII white-space
characters; ``bytes.split`` has exactly that meaning on UTF-8, and
``bytes.lower`` folds A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.array([self[w] for w in words], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return h ^ (h >> _SHIFT)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; order counts."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    acc = mixed(hashes[:n])
    for k in range(1, width):
        acc = mixed(acc * _MUL + hashes[k : k + n])
    return acc


_BASE = 0x9E3779B97F4A7C15
_WORD_BYTE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 1 << 20
_LONG = 128


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = np.full(n, _BASE, dtype=np.uint64)
    base[0] = 1
    inverse = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _chunk_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in a buffer that neither starts nor ends inside a word."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = _WORD_BYTE[buf]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = 1 << max(20, len(buf).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    # Only long words of a certain making are known to collide under a polynomial modulo a power of two.
    for k in np.flatnonzero(ends - starts > _LONG):
        hashes[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes())
    return hashes, starts


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashes of the words of each text, A-Z lowered: a polynomial over the bytes from prefix sums, so one pass of numpy does many texts."""
    joined = b"\n".join(texts).lower()
    buf = np.frombuffer(joined, dtype=np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(at + _CHUNK, len(buf))
        while end < len(buf) and _WORD_BYTE[buf[end]]:
            end += 1
        h, s = _chunk_hashes(buf[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return np.split(np.concatenate(hashes), np.searchsorted(np.concatenate(starts), first[1:]))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    sets = []
    for h in word_hashes(texts):
        n = len(h)
        if 0 < n < width:
            sets.append(mixed(windows(h, n) + np.uint64(n)))
        else:
            w = np.sort(windows(h, width))
            sets.append(w[np.concatenate([[True], w[1:] != w[:-1]])] if len(w) else w)
    return sets


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that ``column`` holds about ``most_bytes`` a slice (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def encoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts, A-Z lowered, as places in an array of distinct words; how many each text has; that array.

    Arrow counts blank ends as empty words; they are left out, but may stay in the array.
    """
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    values = found.flatten().dictionary_encode()
    code, count = values.indices.to_numpy(), np.diff(found.offsets.to_numpy()).astype(np.int64)
    blank = pc.index(values.dictionary, pa.scalar("", values.dictionary.type)).as_py()
    if blank >= 0:
        keep = code != blank
        count = np.bincount(np.repeat(np.arange(len(count)), count)[keep], minlength=len(count))
        code = code[keep]
    return code, count, values.dictionary
