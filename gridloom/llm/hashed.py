"""Words of many texts as 64-bit hashes, made in Arrow and NumPy.

Texts are lower-cased (A-Z only) and cut at space and U+0009..U+000D. Words are made distinct first; a word's
hash is the sum of its bytes times fixed random multipliers, mixed. The same everywhere and in every run.
"""

from __future__ import annotations

import ctypes
import inspect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FIXED = np.random.Generator(np.random.PCG64(20240229))
_BY_PLACE = _FIXED.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BY_TURN = _FIXED.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _multipliers(n: int) -> np.ndarray:
    if n <= len(_BY_PLACE):
        return _BY_PLACE[:n]
    return np.concatenate([_BY_PLACE, mix(np.arange(len(_BY_PLACE), n, dtype=np.uint64)) | np.uint64(1)])


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string of an array without nulls."""
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(bounds)
    if not len(words) or not sizes.sum():
        return np.zeros(len(words), np.uint64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64)
    place = np.arange(len(raw)) - np.repeat(bounds[:-1] - bounds[0], sizes)
    part = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * _multipliers(int(sizes.max()))[place])])
    at = bounds - bounds[0]
    return mix(part[at[1:]] - part[at[:-1]])


def compact(column: pa.Array) -> pa.Array:
    """A copy that starts at offset 0: splitting a slice of an array goes by the offsets of the whole."""
    return column.take(pa.array(np.arange(len(column)))) if column.offset else column


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in a row, offsets of each text among them); null has none."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(compact(texts).cast(pa.large_string()), "")))
    bounds = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    hashes = hash_strings(coded.dictionary)[coded.indices.to_numpy()]
    bounds = bounds - bounds[0]
    # cuts at either end of a text leave empty strings
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
    if full.all():
        return hashes, bounds
    return hashes[full], np.concatenate([[0], np.cumsum(full)])[bounds]


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n values in a row, across texts too."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * _BY_TURN[k]
    return mix(out)


def blocks(column: pa.Array, most: int = 8 << 20):
    """(first row, rows) of runs of about ``most`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        upto = max(at + 1, min(upto, len(column)))
        yield at, upto - at
        at = upto


def trim() -> None:
    """Give what this worker has freed back to the system: workers are kept for later tasks, whose memory it would add to."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def trimmed(run):
    """``run``, over batches in a worker, followed by :func:`trim`."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def trimmed_groups(run):
    """``run``, over a group (key, table) or two that meet (key, left, right) in a worker, followed by :func:`trim`."""
    # Spark tells the two kinds by the number of arguments
    if len(inspect.signature(run).parameters) == 2:

        def whole(key, table):
            out = run(key, table)
            trim()
            return out
    else:

        def whole(key, left, right):
            out = run(key, left, right)
            trim()
            return out

    return whole
