"""Hashed character n-grams of many strings at once, in numpy.

Strings are laid end to end as code points; an n-gram's hash is rolled over the whole
array and n-grams that would cross a string's end are masked.  No Python runs per
character or per string beyond joining them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Grams:
    """``ids``: buckets of all n-grams, string by string; ``starts``: where each string's begin (each has one at least)."""

    ids: np.ndarray
    starts: np.ndarray


def grams(strings: list[str], orders: tuple[int, ...], bits: int) -> Grams:
    """n-grams of ``orders`` of each string, framed by blanks so that each string has some."""
    if not strings:
        return Grams(np.empty(0, np.int64), np.empty(0, np.int64))
    pad = max(orders)
    joined = "\n".join(f" {s} " for s in strings) + "\n" * pad
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(s) + 3 for s in strings), np.int64, len(strings))
    ends = np.cumsum(lengths) - 1  # where each string's newline stands
    size = int(ends[-1]) + 1
    owner_end = np.repeat(ends, lengths)
    position = np.arange(size)
    parts, where = [], []
    h = np.zeros(size, np.uint64)
    for n in range(1, pad + 1):
        h = (h ^ (code[n - 1 : n - 1 + size] + np.uint64(n))) * _P
        h ^= h >> np.uint64(29)
        if n in orders:
            keep = position + n <= owner_end
            parts.append((((h * _Q) >> np.uint64(64 - bits)).astype(np.int64))[keep])
            where.append(position[keep])
    if len(parts) == 1:
        ids, at = parts[0], where[0]
    else:
        at = np.concatenate(where)
        order = np.argsort(at, kind="stable")
        ids, at = np.concatenate(parts)[order], at[order]
    begins = np.concatenate(([0], ends[:-1] + 1))
    return Grams(ids, np.searchsorted(at, begins))


def summed(table: np.ndarray, g: Grams, chunk: int = 1 << 20) -> np.ndarray:
    """Per string the sum of ``table``'s rows over its n-grams, in chunks of whole strings to bound memory."""
    n = len(g.starts)
    out = np.zeros((n, *table.shape[1:]), np.float32)
    bounds = np.append(g.starts, len(g.ids))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + chunk, "right")) - 1)
        out[i:j] = np.add.reduceat(table[g.ids[bounds[i] : bounds[j]]], bounds[i:j] - bounds[i], axis=0)
        i = j
    return out


def fast_sums(table: np.ndarray, strings: list[str], orders: tuple[int, ...], bits: int, chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Per string the sum of ``table``'s rows over its n-grams, and their number: as ``summed(table, grams(...))``.

    ``table`` has one row of zeros beyond its 2^bits buckets, which n-grams across a
    string's end fall on, so nothing is masked out or sorted; rows are gathered in chunks
    that stay in the cache.
    """
    pad = max(orders)
    joined = "\n".join(f" {s} " for s in strings) + "\n" * pad
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(s) + 3 for s in strings), np.int64, len(strings))
    ends = np.cumsum(lengths) - 1
    begins, size = ends - lengths + 1, int(ends[-1]) + 1
    room = np.repeat(ends, lengths) - np.arange(size)
    h = np.zeros(size, np.uint64)
    ids, counts = [], np.zeros(len(strings), np.int64)
    for n in range(1, pad + 1):
        h = (h ^ (code[n - 1 : n - 1 + size] + np.uint64(n))) * _P
        h ^= h >> np.uint64(29)
        if n in orders:
            at = ((h * _Q) >> np.uint64(64 - bits)).astype(np.int32)
            at[room < n] = 1 << bits
            ids.append(at)
            counts += np.maximum(lengths - n, 0)
    out = np.empty((len(strings), *table.shape[1:]), np.float32)
    i = 0
    while i < len(strings):
        j = min(len(strings), max(i + 1, int(np.searchsorted(begins, begins[i] + chunk, "right")) - 1))
        a, b = begins[i], ends[j - 1] + 1
        rows = table[ids[0][a:b]]
        for at in ids[1:]:
            rows += table[at[a:b]]
        out[i:j] = np.add.reduceat(rows, begins[i:j] - a, axis=0)
        i = j
    return out, counts


def with_nothing(table: np.ndarray) -> np.ndarray:
    """A table with the row of zeros that ``fast_sums`` needs."""
    return np.concatenate([table, np.zeros((1, *table.shape[1:]), table.dtype)])
