"""Words, lines and their repeats in a run of whole texts, all at once on byte arrays."""

from __future__ import annotations

import numpy as np

from usageloom.llm.arrays import mix, range_hashes

#: White space that ends a word: space and U+0009..U+000D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOLS = b"#*$%&|<>"


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL = byte_class(SYMBOLS)
#: Bytes that begin a code point.
_LEADS = (np.arange(256) & 0xC0) != 0x80


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a per-position array between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class Words:
    """Word bounds, word counts and word hashes of consecutive texts."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
        after = np.concatenate([solid[1:], [False]]) if len(data) else solid
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.solid = solid
        self.cuts = np.searchsorted(self.starts, bounds)
        self.count = np.diff(self.cuts)
        self.text = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows inside one text, and their hashes, which differ between texts."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        key = mix(self.text[:n].astype(np.uint64))
        for k in range(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
        first = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return first, key[first]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of keys that occur twice or more, and of those that are not the first."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    later = np.zeros(len(keys), bool)
    later[order] = same
    any_ = np.zeros(len(keys), bool)
    any_[order[:-1]] = same[1:]
    return any_ | later, later


def repeated_words(words: Words, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """Per text, the words inside windows that occur twice or more in the text."""
    first, keys = words.windows(hashes, size)
    twice = first[repeated(keys)[0]]
    covered = np.zeros(len(hashes), bool)
    for k in range(size):
        covered[twice + k] = True
    return per_text(covered, words.cuts)


def lines(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the text each belongs to."""
    breaks = np.flatnonzero(words.data == 10)
    starts = np.sort(np.concatenate([words.bounds[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([words.bounds[1:], breaks]))
    counts = np.diff(np.searchsorted(breaks, words.bounds)) + 1
    return starts, ends, np.repeat(np.arange(len(counts)), counts)


def duplicate_lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Per text, lines with a word that equal an earlier line, and all lines with a word."""
    starts, ends, text = lines(words)
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, text = starts[full], ends[full], text[full]
    keys = mix(range_hashes(words.data, starts, ends) + mix(text.astype(np.uint64)))
    n = len(words.count)
    return np.bincount(text[repeated(keys)[1]], minlength=n), np.bincount(text, minlength=n)


def base_counts(words: Words, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts that quality rules begin with."""
    leads = _LEADS[words.data]
    return {
        "n_words": words.count,
        "word_chars": per_text(leads & words.solid, words.bounds),
        "n_symbols": per_text(_SYMBOL[words.data], words.bounds),
        "n_dup_lines": duplicate_lines(words)[0],
        "n_repeat_words": repeated_words(words, hashes),
    }
