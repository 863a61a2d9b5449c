"""Contexts as windows of the sequences they were cut from, and lists; numpy and Arrow only, for use inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def as_lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(m.ravel()))


def weighted_sums(vecs: pa.Array) -> pa.Array:
    """The sum of place times element of every list, places from 1; null for a null list. Elements are not null."""
    lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
    values = vecs.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and lengths[0] and (lengths == lengths[0]).all():
        width = int(lengths[0])
        return pa.array(values.reshape(-1, width) @ np.arange(1.0, width + 1))
    sizes = np.nan_to_num(lengths).astype(np.int64)
    ends = np.cumsum(sizes)
    place = np.arange(len(values)) - np.repeat(ends - sizes, sizes) + 1.0
    sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), values * place, len(sizes))
    return pa.array(sums, mask=np.isnan(lengths.astype(np.float64)))


def last_known(contexts: pa.Array, pad: int) -> np.ndarray:
    """The last ID of every context that is not ``pad``; -1 where there is none or it is null."""
    ids = contexts.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    lengths = contexts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    places = np.flatnonzero(ids != pad)
    if not len(places):
        return np.full(len(lengths), -1, dtype=np.int64)
    before = np.searchsorted(places, ends) - 1
    at = places[np.maximum(before, 0)]
    return np.where((before >= 0) & (at >= ends - lengths), ids[at].astype(np.int64), -1)


def joined_windows(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): contexts as windows of one sequence; one that is the former moved on by an ID adds only that."""
    length = block.shape[1]
    first = np.append(True, (block[1:, :-1] != block[:-1, 1:]).any(axis=1))
    ends = np.cumsum(np.where(first, length, 1)) - 1
    ids = np.empty(ends[-1] + 1, dtype=block.dtype)
    ids[ends] = block[:, -1]
    ids[ends[first][:, None] - np.arange(length - 1, 0, -1)] = block[first, :-1]
    return ids, ends - (length - 1)


def _run_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 63-bit hash of every run of ``width`` IDs."""
    n = len(ids) - width + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h ^= ids[j : j + n].astype(np.uint64)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(1)).astype(np.int64)


def segments(block: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sizes, ids): contexts of one length as stretches that follow each other and share a key.

    The key of a context is the least hash of its runs of ``width`` IDs, so equal contexts have equal keys,
    and most contexts have that of the one before.
    """
    length = block.shape[1]
    width = min(width, length)
    ids, starts = joined_windows(block)
    hashes = np.lib.stride_tricks.sliding_window_view(_run_hashes(ids, width), length - width + 1)
    keys = hashes.min(axis=1)[starts]
    first = np.flatnonzero(np.append(True, (np.diff(starts) != 1) | (np.diff(keys) != 0)))
    last = np.append(first[1:], len(starts)) - 1
    sizes = starts[last] + length - starts[first]
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(starts[first] - (ends - sizes), sizes)
    return keys[first], sizes, ids[at]
