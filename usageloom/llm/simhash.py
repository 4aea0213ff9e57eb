"""SimHash near-duplicates found by bit-sliced comparison.

Fingerprints within the radius agree on at least ``keyed`` of ``radius + keyed``
bit blocks, so rows are dealt by every choice of blocks and compared inside the
buckets. A bucket is stored as vertical bit planes, 64 fingerprints to a machine
word; differences are counted for all lanes at once by carry-save adders, and
words whose lanes all exceed the radius are abandoned on the way. Buckets larger
than a tile are compared tile against tile by different tasks. A tile returns a
spanning forest of its links, never the pairs.

Defined cases: a null text is empty; texts without a word have fingerprint zero
and link like any other; equal fingerprints are compared once; null doc_ids take
part and get the least known doc_id of their component, or null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import bytes_of, column
from usageloom.llm.components import components
from usageloom.llm.staging import Stage, packed, unpacked

WORDS = 4
SEED = 42
BITS = 64
RADIUS = 4
#: Fingerprints of one bucket compared by one task; larger buckets are tiled.
TILE = 1024
_CELLS = 1 << 16
_SHINGLES = 1 << 16

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, size: int = WORDS) -> np.ndarray:
    """Hashes of all word shingles of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        hashed = digest(joined, SEED)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - size + 1].tolist()
        hashed = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())])
    return np.frombuffer(hashed, ">u8")


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is 1 if it is set in more than half of them."""
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), _SHINGLES):
        part = hashes[first : first + _SHINGLES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: bytes, size: int = WORDS) -> int:
    """The fingerprint of a text, from its word shingles."""
    return folded(shingle_hashes(text, size))


def with_fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, a hash of the text and the fingerprint (as signed longs) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bytes_of(column(batch, "text"))
            raw = data.tobytes()
            cut = bounds.tolist()
            prints = [fingerprint(raw[a:b], size) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "text_key"), pa.array(prints, pa.int64())],
                ["doc_id", "text_key", "fp"],
            )

    texts = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.mapInArrow(run, "doc_id long, text_key long, fp long")


def _keys(keyed: int, radius: int) -> list[Column]:
    """One bucket key per choice of ``keyed`` bit blocks."""
    blocks = radius + keyed
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    out = []
    for table, chosen in enumerate(combinations(range(blocks), keyed)):
        mask = sum(((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        out.append(F.struct(F.lit(table).alias("t"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("k")))
    return out


def keyed_blocks(fingerprints: int, radius: int = RADIUS) -> int:
    """How many blocks a key joins so that evenly spread fingerprints fill about half a tile."""
    keyed = 1
    while fingerprints >> (BITS * keyed // (radius + keyed)) > TILE // 2:
        keyed += 1
    return keyed


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is above the radius."""
    above, equal = over.copy(), ~over
    for bit in range(len(counter) - 1, -1, -1):
        if radius >> bit & 1:
            equal &= counter[bit]
        else:
            above |= equal & counter[bit]
            equal &= ~counter[bit]
    return above


def near_lanes(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int):
    """Cells (query row, plane word) that still have lanes within the radius, and those lanes."""
    depth = max(1, radius.bit_length())
    value = fps[query]
    counter = [np.zeros(len(query), np.uint64) for _ in range(depth)]
    over = np.zeros(len(query), np.uint64)
    one = np.uint64(1)
    for plane in range(0, BITS, 2):
        p, q = np.uint64(plane), np.uint64(plane + 1)
        a = planes[plane][word] ^ (((value >> p) & one) * _ALL)
        b = planes[plane + 1][word] ^ (((value >> q) & one) * _ALL)
        half = counter[0] ^ a
        carry = (counter[0] & a) | (half & b)
        counter[0] = half ^ b
        for bit in range(1, depth):
            counter[bit], carry = counter[bit] ^ carry, counter[bit] & carry
        over |= carry
        if plane % 8 == 6 and plane >= 14:
            lanes = lanes & ~_exceeds(counter, over, radius)
            left = np.flatnonzero(lanes)
            if len(left) < 0.8 * len(lanes):
                query, word, value, lanes, over = (x[left] for x in (query, word, value, lanes, over))
                counter = [x[left] for x in counter]
                if not len(query):
                    break
    return query, word, lanes & ~_exceeds(counter, over, radius)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row each row reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def block_links(group: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root fingerprint) inside groups of rows.

    ``group`` is ascending. Rows of side 0 form the planes of their group; side
    1 queries them. A group without side 1 is compared with itself.
    """
    n = len(fps)
    groups, first = np.unique(group, return_index=True)
    index = np.searchsorted(groups, group)
    cross = np.bincount(index, side == 1, len(groups)) > 0
    stored = side == 0
    count = np.bincount(index, stored, len(groups)).astype(np.int64)
    words = (count + 63) // 64
    base = np.cumsum(words) - words
    nth = np.cumsum(stored) - 1
    before = np.concatenate([[0], np.cumsum(count)[:-1]])
    place = nth - before[index]
    lane_row = np.zeros(int(words.sum()) * 64, np.int64)
    live = np.zeros(len(lane_row), np.uint8)
    lane = base[index] * 64 + place
    lane_row[lane[stored]] = np.flatnonzero(stored)
    live[lane[stored]] = 1
    bits = np.unpackbits(fps[lane_row].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)
    live_words = np.packbits(live, bitorder="little").view("<u8").astype(np.uint64)
    asks = np.flatnonzero(~stored | ~cross[index])
    skip = np.where(cross[index[asks]], 0, place[asks] // 64)
    cells = words[index[asks]] - skip
    lefts, rights = [], []
    bound = np.concatenate([[0], np.cumsum(cells)])
    at = 0
    while at < len(asks):
        to = max(at + 1, int(np.searchsorted(bound, bound[at] + _CELLS, "right")) - 1)
        some, size = asks[at:to], cells[at:to]
        query = np.repeat(some, size)
        step = np.arange(len(query)) - np.repeat(bound[at:to] - bound[at], size)
        word = np.repeat(base[index[some]] + skip[at:to], size) + step
        lanes = live_words[word]
        own = (step == 0) & ~cross[index[query]]
        shift = (place[query] % 64).astype(np.uint64)
        lanes = np.where(own, lanes & ~((np.uint64(2) << shift) - np.uint64(1)), lanes)
        keep = np.flatnonzero(lanes)
        query, word, lanes = near_lanes(fps, planes, query[keep], word[keep], lanes[keep], radius)
        hit = np.flatnonzero(lanes)
        if len(hit):
            found = np.unpackbits(lanes[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, bit = np.nonzero(found)
            lefts.append(query[hit][cell])
            rights.append(lane_row[word[hit][cell] * 64 + bit])
        at = to
    if not lefts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    root = _forest(n, np.concatenate(lefts), np.concatenate(rights))
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved].astype(np.int64), fps[root[moved]].astype(np.int64)


def links(stage: Stage, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) between distinct fingerprints whose components are those of the radius.

    ``fingerprints`` has one column fp of distinct values and is read twice.
    """
    keyed = keyed_blocks(fingerprints.count(), radius)
    rows = fingerprints.select("fp", F.explode(F.array(*_keys(keyed, radius))).alias("b")).select("b.t", "b.k", "fp")
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")
    dealt = (
        rows.join(sizes, ["t", "k"])
        .withColumn("m", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select(
            F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("g"),
            "t", "k",
            F.least("own", "other").alias("a"),
            F.greatest("own", "other").alias("b"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "fp",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            g = table.column("g").to_numpy()
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if cut:
                yield solve(table.slice(0, cut))
            rest = table.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield solve(rest)

    def solve(table: pa.Table) -> pa.RecordBatch:
        names = [table.column(x).to_numpy() for x in ("g", "t", "k", "a", "b")]
        change = np.zeros(table.num_rows, bool)
        for x in names:
            change[1:] |= x[1:] != x[:-1]
        fps = table.column("fp").to_numpy().astype(np.uint64)
        u, v = block_links(np.cumsum(change), table.column("side").to_numpy(), fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return (
        dealt.repartition("g")
        .sortWithinPartitions("g", "t", "k", "a", "b")
        .mapInArrow(run, "u long, v long")
    )


def with_roots(stage: Stage, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of distinct fingerprints (fp) and the least fingerprint each reaches over links of the radius (root)."""
    found = components(stage, links(stage, fingerprints.select("fp"), radius))
    return fingerprints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, text_key, fp, its component's least fp (root) and least doc_id."""
    stage = Stage(docs.sparkSession, "simhash")
    prints = stage.keep(with_fingerprints(docs, size))
    nodes = stage.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = with_roots(stage, nodes, radius)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stage.keep(rooted.join(least, "root").select("fp", "root", "component_id"))
    stage.leave(prints, classes)
    return prints.join(classes, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component, that of the least doc_id (null first), with its own columns."""
    least = F.lit(-(1 << 63)).cast("long")
    keys = [F.coalesce(F.col("doc_id").cast("long"), least).alias("d"), F.xxhash64("text").alias("h")]
    chosen = (
        near_duplicates(docs, size, radius)
        .groupBy("root")
        .agg(F.min(F.struct(F.coalesce("doc_id", least).alias("d"), F.col("text_key").alias("h"))).alias("k"))
        .select("k.*")
    )
    kept = packed(docs, *keys).join(chosen, ["d", "h"]).dropDuplicates(["d", "h"])
    return unpacked(kept)
