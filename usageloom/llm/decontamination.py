"""Benchmark decontamination by greedy string tiling.

Runs of shared tokens (seeds) join documents and benchmark items; for each pair
that shares a seed the longest non-overlapping matches are marked again and
again, found by Karp-Rabin hashes, until none of the least length is left. The
share of an item's tokens under tiles is its coverage: it stays high when the
passages of an item are reordered or spread over a document.

The benchmark is indexed in slices of bounded size; each slice is broadcast and
passes over the documents once, so a large benchmark costs more passes, never a
larger broadcast. Documents are neither shuffled nor cut.

Defined cases: null and empty texts have no tokens; items of fewer tokens than a
seed never match; repeated documents and items are judged one by one, items of
equal text under their own ids; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import column, mix, slices, tidy
from usageloom.llm.staging import packed, unpacked

#: Tokens of a seed and of the shortest tile.
MIN_MATCH = 5
#: Share of an item's tokens that makes a document contaminated.
COVERAGE = 0.5
#: Bytes of benchmark text in one broadcast.
SLICE = 8 << 20

LEAK = "struct<item_id:bigint,coverage:double,matched:int,tokens:int,tiles:int>"

_PRIME = (1 << 61) - 1
_RADIX = 1_000_003
#: ASCII signs that separate tokens.
_GAPS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of a lower-cased text, without ASCII signs."""
    return text.translate(_GAPS).split()


def _windows(ids: list[int], marked: bytearray, size: int) -> Iterator[tuple[int, int]]:
    """Starts and rolling hashes of all windows without a marked token or a gap (id below 0)."""
    top = pow(_RADIX, size - 1, _PRIME)
    value, length = 0, 0
    for at, token in enumerate(ids):
        if token < 0 or marked[at]:
            value, length = 0, 0
            continue
        if length == size:
            value -= (ids[at - size] + 1) * top
            length -= 1
        value = (value * _RADIX + token + 1) % _PRIME
        length += 1
        if length == size:
            yield at - size + 1, value


def tile(item: list[int], text: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length), longest first; ids below 0 match nothing."""
    in_item, in_text = bytearray(len(item)), bytearray(len(text))
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), 20))
    while True:
        index = defaultdict(list)
        for at, value in _windows(item, in_item, size):
            index[value].append(at)
        found, longest = [], 0
        for at, value in _windows(text, in_text, size):
            for start in index.get(value, ()):
                length = 0
                while (
                    start + length < len(item)
                    and at + length < len(text)
                    and item[start + length] == text[at + length]
                    and not in_item[start + length]
                    and not in_text[at + length]
                ):
                    length += 1
                if length >= size:
                    found.append((-length, start, at))
                    longest = max(longest, length)
        if longest > 2 * size:
            size = longest
            continue
        for negative, start, at in sorted(found):
            length = -negative
            if not any(in_item[start : start + length]) and not any(in_text[at : at + length]):
                in_item[start : start + length] = b"\1" * length
                in_text[at : at + length] = b"\1" * length
                tiles.append((start, at, length))
        if size > least:
            size = max(least, size // 2)
        elif not found:
            break
    return tiles


@dataclass
class Index:
    """Items of a benchmark slice as token ids, and the items of each seed."""

    vocabulary: dict[bytes, int]
    ids: list[int]
    items: list[list[int]]
    seeds: np.ndarray
    bounds: np.ndarray
    owners: np.ndarray


def seed_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of token ids."""
    n = len(ids) - size + 1
    key = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(key)].astype(np.uint64))
    return key


def build_index(rows: list[tuple[int, str]], size: int = MIN_MATCH) -> Index:
    vocabulary: dict[bytes, int] = {}
    ids, items, keys, owners = [], [], [], []
    for item_id, text in rows:
        own = [vocabulary.setdefault(t, len(vocabulary)) for t in tokens(text.encode())]
        if len(own) < size:
            continue
        found = np.unique(seed_keys(np.array(own, np.int64), size))
        keys.append(found)
        owners.append(np.full(len(found), len(items)))
        ids.append(item_id)
        items.append(own)
    key = np.concatenate([np.empty(0, np.uint64), *keys])
    owner = np.concatenate([np.empty(0, np.int64), *owners])
    order = np.argsort(key, kind="stable")
    seeds, first = np.unique(key[order], return_index=True)
    return Index(vocabulary, ids, items, seeds, np.append(first, len(key)), owner[order])


def leaks(texts: list[bytes], index: Index, size: int = MIN_MATCH, coverage: float = COVERAGE) -> list[list[tuple]]:
    """For each text the items covered enough: (item_id, coverage, matched, tokens, tiles)."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(index.seeds):
        return out
    words = [tokens(text) for text in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    get = index.vocabulary.get
    ids = np.fromiter((i for own in words for i in map(get, own, repeat(-1))), np.int64, int(counts.sum()))
    if len(ids) < size:
        return out
    text = np.repeat(np.arange(len(words)), counts)
    unknown = np.concatenate([[0], np.cumsum(ids < 0)])
    usable = np.flatnonzero((unknown[size:] == unknown[:-size]) & (text[: len(ids) - size + 1] == text[size - 1 :]))
    windows = ids[usable[:, None] + np.arange(size)] if len(usable) else np.empty((0, size), np.int64)
    key = np.zeros(len(usable), np.uint64)
    for k in range(size):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + windows[:, k].astype(np.uint64))
    at = np.minimum(np.searchsorted(index.seeds, key), len(index.seeds) - 1)
    hit = index.seeds[at] == key
    shared: dict[tuple[int, int], list[int]] = defaultdict(list)
    for place, seed in zip(usable[hit].tolist(), at[hit].tolist()):
        for owner in index.owners[index.bounds[seed] : index.bounds[seed + 1]].tolist():
            shared[int(text[place]), owner].append(place)
    for (row, owner), places in shared.items():
        item = index.items[owner]
        # A tile is seeds all over, so tokens outside this item's seeds can't be in one.
        cut: list[int] = []
        end = -1
        for place in places:
            if place > end:
                cut.append(-1)
            cut.extend(ids[max(place, end) : place + size].tolist())
            end = place + size
        tiles = tile(item, cut, size)
        matched = sum(length for _, _, length in tiles)
        if matched >= coverage * len(item):
            out[row].append((index.ids[owner], matched / len(item), matched, len(item), len(tiles)))
    return [sorted(found) for found in out]


def _slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in slices of about SLICE bytes, dealt by a hash of the item."""
    items = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // SLICE))
    dealt = items.withColumn("_slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for number in range(count):
        rows = dealt.where(F.col("_slice") == number).select("item_id", "text").collect()
        yield [tuple(row) for row in rows]


def _marked(docs: DataFrame, benchmark: DataFrame, coverage: float) -> DataFrame:
    """Documents as one column, beside the leaks of each."""
    context = docs.sparkSession.sparkContext
    lower = F.lower(F.coalesce("text", F.lit(""))).alias("lower")
    out = packed(docs, lower, F.lit([]).cast(f"array<{LEAK}>").alias("leaks"))
    schema = f"row {out.schema['row'].dataType.simpleString()}, lower string, leaks array<{LEAK}>"
    for rows in _slices(benchmark):
        shared = context.broadcast(build_index(rows))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                index = batch.schema.get_field_index("leaks")
                kind = batch.schema.field(index).type
                keys = [f.name for f in kind.value_type]
                for part in slices(batch, "lower"):
                    texts = [t.encode() for t in column(part, "lower").to_pylist()]
                    found = [
                        before + [dict(zip(keys, leak)) for leak in own]
                        for before, own in zip(part.column(index).to_pylist(), leaks(texts, shared.value, coverage=coverage))
                    ]
                    yield part.set_column(index, "leaks", pa.array(found, kind))

        out = out.mapInArrow(tidy(run), schema)
    return out.select("row", "leaks")


def with_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Add an array `leaks` of the benchmark items each document contains; other columns pass through."""
    return unpacked(_marked(docs, benchmark, coverage), "leaks")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Documents that contain no benchmark item, with their own columns."""
    return unpacked(_marked(docs, benchmark, coverage).where(F.size("leaks") == 0))
