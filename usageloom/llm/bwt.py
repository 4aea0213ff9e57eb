"""Burrows-Wheeler transforms of string shards and their merge by interleave refinement.

Strings are sequences of small numbers above 0; each ends with 0. The suffixes
of a shard are sorted once. Shards are merged without sorting suffixes again:
an interleave says which shard each place of the merged order comes from, and
passing over the transforms in that order gives the interleave for one symbol
more. A boundary that a pass adds between neighbours is their common prefix.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffixes of strings that lie one after the other, in order; equal ones by string."""
    n = len(text)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    rank = text.astype(np.int64)
    size, longest = 1, int(lengths.max()) if len(lengths) else 0
    order = np.argsort(rank, kind="stable")
    while size < longest:
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > size)
        ahead[inside] = rank[inside + size] + 1
        key = rank * (n + 300) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        size *= 2
    return order


def transform(text: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The symbol before each suffix; 0 before a whole string."""
    before = np.zeros(len(text), np.uint16)
    before[1:] = text[:-1]
    before[np.cumsum(lengths) - lengths] = 0
    return before[order]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes by their first ``depth`` symbols, and common prefixes.

    Returns, for each place of the merged order, the place in the concatenated
    shard orders, and the length of the common prefix with the place before
    (``depth`` where it is at least that).
    """
    symbols = np.concatenate(transforms)
    n = len(symbols)
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    shard = shard.astype(np.uint8 if len(transforms) < 256 else np.uint16)
    prefix = np.full(n, depth, np.int32)
    block = np.zeros(n, np.int64)
    here = np.empty(n, np.uint16)
    for length in range(depth):
        by_shard = np.argsort(shard, kind="stable")
        here[by_shard] = symbols
        order = np.argsort(here, kind="stable")
        sorted_symbols, sorted_block = here[order], block[order]
        cut = (sorted_symbols[1:] != sorted_symbols[:-1]) | (sorted_block[1:] != sorted_block[:-1])
        fresh = np.flatnonzero(cut & (prefix[1:] == depth)) + 1
        prefix[fresh] = length
        following = shard[order]
        if not len(fresh) and np.array_equal(following, shard):
            break
        shard = following
        block[1:] = np.cumsum(cut)
    prefix[:1] = 0
    by_shard = np.argsort(shard, kind="stable")
    place = np.empty(n, np.int64)
    place[by_shard] = np.arange(n)
    return place, prefix
