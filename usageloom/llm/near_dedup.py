"""Near-duplicates by SimHash and exact Jaccard similarity of word shingles.

Fingerprints of the shingles are searched by the bit-sliced comparison of
``simhash``; texts whose fingerprints reach each other are a group, and its
members are compared on the whole sets of shingles, so that only similar texts
link. No radius that can be searched by bit blocks reaches similarity 0.8, where
about 9 of 64 bits differ: blocks that survive so many changes are too short to
part a corpus. Pairs further apart than the radius therefore meet by min-hashes.
Texts that agree on every row of one of ``BANDS`` bands share a bucket, which a
pair of similarity 0.8 misses with probability (1 - 0.8**ROWS)**BANDS, below 11
in a million, and a closer one more rarely. A bucket whose members the
fingerprints have all joined is not compared again. Every link, of either
search, is verified on the whole sets of shingles.

Groups link in two rounds, and pairs never become rows. First each member meets
the hub of its group, the least member; the comparison also says which of the
hub's shingles the member has and which it has besides. Members of a group share
its hub, so every candidate pair lies in the group of one hub. Second, groups
that still hold several components are compared whole: tile against tile inside
a task, on bits of the hub's shingles and of those that members share besides,
which gives exact intersections. A tile returns a spanning forest of the links
it finds, fewer rows than it read. Pairs inside a component cannot change it, so
the components are those of all candidates.

Defined cases: a null text is empty; texts without a word are one group; a text
of fewer words than a shingle is one shingle; texts of equal shingles are one
node, which may have several fingerprints, since those count repeats; null or
repeated doc_ids take part row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import bytes_of, column, give_back, tidy
from usageloom.llm.components import components
from usageloom.llm.simhash import RADIUS, folded, shingle_hashes, with_roots
from usageloom.llm.staging import Stage, packed, unpacked

#: Words of a shingle, and the Jaccard similarity of near-duplicates.
WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 3
#: Members of one hub, and bytes of their sets, that are compared with each other in one task.
TILE = 1024
TILE_BYTES = 4 << 20
#: Shingles that a larger share of a tile's members has are compared as bits.
DENSE = 1 / 16
_CHUNK = 2048

_DRAW = np.random.default_rng(5)
_FLIPS = _DRAW.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_FACTORS = _DRAW.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(hashes.astype(np.uint64))


def shingles(text: bytes) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    return distinct(shingle_hashes(text, WORDS))


def bands(own: np.ndarray) -> np.ndarray:
    """One key per band of min-hashes of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for first in range(0, len(own), _CHUNK):
        np.minimum(least, ((own[first : first + _CHUNK] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    raw, width = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[a : a + width]) for a in range(0, len(raw), width)], np.uint64)


def near_enough(both, union, least: float = SIMILARITY):
    """Whether so many common shingles of so many are similar enough, in whole numbers; two empty sets are."""
    return 1000 * both >= round(1000 * least) * union


def _keys() -> list[Column]:
    least = F.lit(-(1 << 63)).cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), least).alias("d"), F.xxhash64("text").alias("h")]


def with_prints(docs: DataFrame) -> DataFrame:
    """d, h (doc_id and a hash of the text), node (a hash of the shingles), their number, fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bytes_of(column(batch, "text"))
            raw, cut = data.tobytes(), bounds.tolist()
            nodes, sizes, fps, keys = [], [], [], []
            for a, b in zip(cut, cut[1:]):
                hashes = shingle_hashes(raw[a:b], WORDS)
                fps.append(folded(hashes))
                own = distinct(hashes)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                keys.append(bands(own))
            flat = np.concatenate([np.empty(0, np.uint64), *keys]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "d"), column(batch, "h"), pa.array(np.array(nodes, np.uint64).astype(np.int64)),
                    pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()),
                    pa.array(list(flat.reshape(-1, BANDS)), pa.list_(pa.int64())),
                ],
                ["d", "h", "node", "size", "fp", "keys"],
            )

    texts = docs.select(*_keys(), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(run), "d long, h long, node long, size int, fp long, keys array<long>")


def with_shingles(texts: DataFrame) -> DataFrame:
    """node and its shingle hashes, from node and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = bytes_of(column(batch, "text"))
            raw, cut = data.tobytes(), bounds.tolist()
            sets = [shingles(raw[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(sets, pa.binary())], ["node", "own"])

    return texts.mapInArrow(tidy(run), "node long, own binary")


STARS = "u long, v long, size int, near boolean, has binary, besides binary"


def with_hubs(stars: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Each member u of a hub v: similar enough or not, and its set relative to the hub's.

    ``has`` are bits over the hub's ascending shingles, ``besides`` the member's other shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, near, has, besides = [], [], [], []
            for x, y in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist()):
                own, hub = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = np.isin(own, hub, assume_unique=True)
                both = int(shared.sum())
                union = len(own) + len(hub) - both
                sizes.append(len(own))
                near.append(near_enough(both, union, least))
                has.append(np.packbits(np.isin(hub, own, assume_unique=True)).tobytes())
                besides.append(own[~shared].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "u"), column(batch, "v"), pa.array(sizes, pa.int32()), pa.array(near, pa.bool_()),
                    pa.array(has, pa.binary()), pa.array(besides, pa.binary()),
                ],
                ["u", "v", "size", "near", "has", "besides"],
            )

    member = sets.select(F.col("node").alias("u"), F.col("own").alias("a"))
    hub = sets.select(F.col("node").alias("v"), F.col("own").alias("b"))
    return stars.join(member, "u").join(hub, "v").select("u", "v", "a", "b").mapInArrow(tidy(run), STARS)


def intersections(has: list[bytes], besides: list[bytes], split: int = 0) -> np.ndarray:
    """Number of common shingles of all pairs of members of one hub.

    Frequent shingles are bits, compared a word at a time; each rare one adds to
    the few pairs that have it. With ``split`` rows are the members before it,
    and columns those from it on.
    """
    n = len(has)
    bits = np.frombuffer(b"".join(has), np.uint8).reshape(n, -1)
    lengths = np.array([len(b) // 8 for b in besides])
    _, column_of, seen = np.unique(np.frombuffer(b"".join(besides), np.uint64), return_inverse=True, return_counts=True)
    row_of = np.repeat(np.arange(n), lengths)
    frequent = seen > max(2, DENSE * n)
    place = np.cumsum(frequent) - 1
    more = np.zeros((n, int(frequent.sum())), np.bool_)
    chosen = frequent[column_of]
    more[row_of[chosen], place[column_of[chosen]]] = True
    packed_bits = np.concatenate([bits, np.packbits(more, axis=1)], axis=1)
    words = np.zeros((n, -(-packed_bits.shape[1] // 8) * 8), np.uint8)
    words[:, : packed_bits.shape[1]] = packed_bits
    words = words.view(np.uint64)
    common = np.zeros((split or n, n - split), np.int32)
    for i in range(split or n):
        start = split or i
        common[i, start - split :] = np.bitwise_count(words[i] & words[start:]).sum(axis=1, dtype=np.int32)
    few = np.flatnonzero((seen[column_of] > 1) & ~chosen)
    few = few[np.lexsort((row_of[few], column_of[few]))]
    columns, rows = column_of[few], row_of[few]
    for step in range(1, int(seen[~frequent].max(initial=0))):
        same = np.flatnonzero(columns[:-step] == columns[step:])
        if not len(same):
            break
        low, high = rows[same], rows[same + step]
        if split:
            across = (low < split) & (high >= split)
            low, high = low[across], high[across]
        np.add.at(common, (low, high - split), 1)
    if not split:
        for i in range(n):
            common[i:, i] = common[i, i:]
    return common


def forest(nodes: np.ndarray, sizes: np.ndarray, comps: np.ndarray, common: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links between members of different components that join them all; no link that joins nothing.

    ``common`` has the rows of the first members and the columns of the last ones.
    """
    comps = comps.copy()
    out = []
    first_column = len(nodes) - common.shape[1]
    for i in range(len(common)):
        near = near_enough(common[i], sizes[i] + sizes[first_column:] - common[i], least) & (comps[first_column:] != comps[i])
        others = first_column + np.flatnonzero(near)
        if not len(others):
            continue
        labels, first = np.unique(comps[others], return_index=True)
        out += [(nodes[i], nodes[others[j]]) for j in first]
        comps[np.isin(comps, labels)] = comps[i]
    return out


def within_hubs(stars: DataFrame, comps: DataFrame) -> DataFrame:
    """Links (u, v) that join components inside the groups of hubs, a spanning forest per tile pair.

    ``comps`` says the component (comp) of linked nodes. A group of n members is
    dealt as tiles, and each row goes to the tasks of its tile with every tile.
    """
    known = stars.join(comps.withColumnRenamed("node", "u"), "u", "left").withColumn("comp", F.coalesce("comp", "u"))
    groups = (
        known.groupBy("v")
        .agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum(F.octet_length("has") + F.octet_length("besides")).alias("bytes"))
        .where("low <> high")
    )
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    rows = (
        known.drop("near")
        .join(groups.select("v", tiles.alias("m")), "v")
        .withColumn("own", F.pmod(F.xxhash64("u"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .withColumn("a", F.least("own", "other"))
        .withColumn("b", F.greatest("own", "other"))
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("own")
        nodes, sizes, labels, own = (group.column(c).to_numpy() for c in ("u", "size", "comp", "own"))
        links = []
        if len(np.unique(labels)) > 1:
            split = int((own == own[0]).sum())
            common = intersections(group.column("has").to_pylist(), group.column("besides").to_pylist(), split if split < len(own) else 0)
            links = forest(nodes, sizes, labels, common)
            del common
            give_back()
        u, v = zip(*links) if links else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return rows.select("v", "a", "b", "own", "u", "size", "comp", "has", "besides").groupBy("v", "a", "b").applyInArrow(run, "u long, v long")


def by_fingerprints(stage: Stage, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Texts (node) whose fingerprints reach each other, with the least of them (hub)."""
    classes = with_roots(stage, stage.keep(prints.select("fp").distinct()), radius)
    rows = prints.select("node", "fp").distinct().join(classes, "fp").select("root", "node").distinct()
    shared = rows.groupBy("root").agg(F.min("node").alias("hub"), F.max("node").alias("high")).where("hub <> high")
    return rows.join(shared.select("root", "hub"), "root").select("node", "hub").distinct()


def by_bands(prints: DataFrame) -> DataFrame:
    """Texts (node) that agree on a band t with key k, with the least of them (hub)."""
    rows = prints.select("node", F.posexplode("keys").alias("t", "k"))
    shared = rows.groupBy("t", "k").agg(F.min("node").alias("hub"), F.max("node").alias("high")).where("hub <> high")
    return rows.join(shared.select("t", "k", "hub"), ["t", "k"]).select("t", "k", "node", "hub").distinct()


def still_apart(banded: DataFrame, comps: DataFrame) -> DataFrame:
    """Members (node, hub) of the buckets that hold several components."""
    known = banded.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = known.groupBy("t", "k").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return banded.join(several.select("t", "k"), ["t", "k"]).select("node", "hub").distinct()


def rooted(stage: Stage, found: DataFrame) -> DataFrame:
    """Linked nodes and their components (comp)."""
    return components(stage, found).select("node", F.col("root").alias("comp"))


def as_links(comps: DataFrame) -> DataFrame:
    """One link (u, v) per node to its component: enough to find the component again."""
    return comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))


def verified(stage: Stage, members: DataFrame, sets: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Components (node, comp) of the known ones and of the similar members (node) of each hub."""
    pairs = members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    stars = stage.keep(with_hubs(pairs, sets))
    first = stars.where("near").select("u", "v")
    if known is not None:
        first = as_links(known).union(first)
    comps = rooted(stage, first)
    return rooted(stage, as_links(comps).union(within_hubs(stars, comps)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: d, h, node and root, the least node of its component."""
    stage = Stage(docs.sparkSession, "near-dedup", shuffled=True)
    prints = stage.keep(with_prints(docs))
    alike = stage.keep(by_fingerprints(stage, prints))
    banded = stage.keep(by_bands(prints))
    members = alike.select("node").union(banded.select("node")).distinct()
    chosen = prints.join(members, "node").groupBy("node").agg(F.min(F.struct("d", "h")).alias("key"))
    texts = docs.select(*_keys(), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(chosen.select("key.*", "node"), ["d", "h"]).dropDuplicates(["node"]).select("node", "text")
    sets = stage.keep(with_shingles(found))
    close = verified(stage, alike, sets)
    far = verified(stage, still_apart(banded, close), sets, close)
    out = stage.keep(prints.select("d", "h", "node").join(far, "node", "left").withColumn("root", F.coalesce("comp", "node")))
    stage.leave(out)
    return out.select("d", "h", "node", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id (null first), with its own columns."""
    chosen = near_duplicates(docs).groupBy("root").agg(F.min(F.struct("d", "h")).alias("k")).select("k.*")
    return unpacked(packed(docs, *_keys()).join(chosen, ["d", "h"]).dropDuplicates(["d", "h"]))
