"""Context-tree weighting over byte contexts, on sorted arrays.

A code holds the context bytes, nearest first, above the byte that follows:
sorted codes lie in the order of the context tree. The next byte is read bit by
bit; each of its 255 binary nodes has a tree of contexts of its own. A node
weighs its own Krichevsky-Trofimov estimate against the product of the trees
below it, so its posterior weight of stopping mixes all depths.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 5
#: Depth below which one task holds whole subtrees; shallower nodes are dense arrays.
LOCAL = 2
_LN2 = float(np.log(2.0))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(product)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of bit counts under the Krichevsky-Trofimov estimate."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - 1.1447298858494002


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def codes(data: np.ndarray, skip: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Codes of all positions but those flagged; flagged ones are padding of ``depth`` bytes or more."""
    at = np.flatnonzero(~skip)
    wide = data.astype(np.uint64)
    out = wide[at]
    for k in range(1, depth + 1):
        out |= wide[at - k] << np.uint64(8 * (depth - k + 1))
    return out


def _nodes(code: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context and leading bits of the next byte) with their bit counts."""
    key = _node_key(code, bit)
    one = ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    if not len(first):
        return key, np.empty(0), np.empty(0)
    return key[first], np.add.reduceat(counts * (1 - one), first), np.add.reduceat(counts * one, first)


def _node_key(code: np.ndarray, bit: int) -> np.ndarray:
    lead = (code & np.uint64(255)) >> np.uint64(8 - bit)
    return (code & ~np.uint64(255)) | (np.uint64(1 << bit) | lead)


@dataclass
class Level:
    """Nodes of one depth for one bit: keys, estimate of a one, weight of stopping."""

    key: np.ndarray
    one: np.ndarray
    stop: np.ndarray


@dataclass
class Subtrees:
    """Levels LOCAL..depth by bit, and what the levels above need."""

    levels: list[list[Level]]
    top_key: np.ndarray
    top_counts: np.ndarray
    top_weighted: np.ndarray


def shorter(code: np.ndarray, drop: int) -> np.ndarray:
    """The same codes without their ``drop`` farthest context bytes."""
    return ((code >> np.uint64(8 * (drop + 1))) << np.uint64(8)) | (code & np.uint64(255))


def build(code: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> Subtrees:
    """Weight the subtrees of some contexts of LOCAL bytes, deepest nodes first."""
    seen = counts > 0
    code, counts = code[seen], counts[seen].astype(np.float64)
    by_depth = {depth: (code, counts)}
    for d in range(depth - 1, LOCAL - 1, -1):
        code, counts = summed(shorter(code, 1), counts)
        by_depth[d] = (code, counts)
    levels: list[list[Level]] = [[] for _ in range(depth - LOCAL + 1)]
    tops = []
    for bit in range(8):
        below = None
        for d in range(depth, LOCAL - 1, -1):
            key, n0, n1 = _nodes(*by_depth[d], bit)
            own = kt(n0, n1)
            if below is None:
                weighted, stop = own, np.ones(len(own))
            else:
                under = np.bincount(np.searchsorted(key, shorter(below[0], 1)), below[1], len(key))
                weighted = np.logaddexp(own, under) - _LN2
                stop = np.exp(np.minimum(0.0, own - _LN2 - weighted))
            levels[d - LOCAL].append(Level(key, (n1 + 0.5) / (n0 + n1 + 1.0), stop))
            below = (key, weighted)
        tops.append((below[0], np.stack([n0, n1]), below[1]))
    return Subtrees(
        levels,
        np.concatenate([t[0] for t in tops]),
        np.concatenate([t[1] for t in tops], axis=1),
        np.concatenate([t[2] for t in tops]),
    )


@dataclass
class Crown:
    """Estimates, stop weights and presence of depths 0 and 1, as dense arrays by node."""

    one: tuple[np.ndarray, np.ndarray]
    stop: tuple[np.ndarray, np.ndarray]
    seen: tuple[np.ndarray, np.ndarray]


def crown(top_key: np.ndarray, top_counts: np.ndarray, top_weighted: np.ndarray) -> Crown:
    """Weight the two depths above all subtrees."""
    key = shorter(top_key, 1).astype(np.int64)
    n = [np.bincount(key, c, 1 << 16) for c in top_counts]
    ones, stops, seen = [], [], []
    under = np.bincount(key, top_weighted, 1 << 16)
    for _ in range(2):
        own = kt(n[0], n[1])
        weighted = np.logaddexp(own, under) - _LN2
        ones.append((n[1] + 0.5) / (n[0] + n[1] + 1.0))
        seen.append(n[0] + n[1] > 0)
        stops.append(np.where(seen[-1], np.exp(np.minimum(0.0, own - _LN2 - weighted)), 0.0))
        under = weighted.reshape(-1, 256).sum(axis=0)
        n = [x.reshape(-1, 256).sum(axis=0) for x in n]
    return Crown((ones[1], ones[0]), (stops[1], stops[0]), (seen[1], seen[0]))


def log10_probability(code: np.ndarray, trees: Subtrees, top: Crown, depth: int = DEPTH) -> np.ndarray:
    """Of each code's byte in its context: bit by bit, all depths mixed.

    Contexts never met in training are no nodes: the deepest known node takes
    the weight that is left.
    """
    total = np.zeros(len(code))
    for bit in range(8):
        one = ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        node = _node_key(code, bit)
        low = (node & np.uint64(255)).astype(np.int64)
        near = (shorter(code, depth - 1) & ~np.uint64(255)).astype(np.int64) | low
        mixed, left, last = np.zeros(len(code)), np.ones(len(code)), np.full(len(code), 0.5)
        for index, p, stop, seen in zip((low, near), top.one, top.stop, top.seen):
            last = np.where(seen[index], np.where(one, p[index], 1 - p[index]), last)
            mixed += left * stop[index] * last
            left *= 1 - stop[index]
        known = np.arange(len(code))
        for d, by_bit in enumerate(trees.levels, LOCAL):
            level = by_bit[bit]
            if not len(level.key) or not len(known):
                break
            want = (shorter(code[known], depth - d) & ~np.uint64(255)) | low[known].astype(np.uint64)
            at = np.minimum(np.searchsorted(level.key, want), len(level.key) - 1)
            hit = level.key[at] == want
            known, at = known[hit], at[hit]
            last[known] = np.where(one[known], level.one[at], 1 - level.one[at])
            mixed[known] += left[known] * level.stop[at] * last[known]
            left[known] *= 1 - level.stop[at]
        total += np.log10(mixed + left * last)
    return total
