"""Exact substring dedup: bytes under a string that starts earlier are removed.

Every string of LENGTH bytes has one anchor, the least hash among its KEY-byte
pieces (the first of equals), so equal strings have equal anchors at equal
places. Consecutive starts with one anchor form a snippet. Strings are compared
only with strings of the same anchor, which finds all equal ones:

1. parts of the corpus report their anchors; those met once are settled,
2. parts send the snippets of all other anchors, equal snippets of a part once,
3. buckets of anchors keep the first of equal snippets; different snippets of an
   anchor, with the anchor's bytes as one symbol, become shards whose
   Burrows-Wheeler transforms are merged by interleave refinement. Intervals of
   the merged order with a common prefix of LENGTH bytes are the repeats; all
   their starts but the earliest are marked,
4. parts cut the marked strings out of their texts.

Anchors met very often are dealt by single strings, so that one anchor's
snippets never need to meet in one task. Blobs are merged as a stream.

Order of occurrences: doc_id (null first), a hash of the text, place. Defined
cases: a null text is empty; rows with equal doc_id and text are one document
and get equal results; texts shorter than LENGTH lose nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm import bwt
from usageloom.llm.arrays import (
    bytes_of,
    column,
    gathered,
    mix,
    pack_keys,
    pack_numbers,
    pack_table,
    range_hashes,
    slices,
    unpack_keys,
    unpack_numbers,
    unpack_table,
)
from usageloom.llm.staging import Stage

LENGTH = 100
KEY = 50
#: Bytes of text in a part.
PART_BYTES = 8 << 20
#: Least number of buckets; it grows with the square root of the parts.
BUCKETS = 256
#: Parts that report an anchor, from which on it is dealt by single strings.
HOT_PARTS = 4096
HOT_IN_PART = 4096
#: Symbols of one shard, and of the shards merged at once (an anchor's snippets stay together).
SHARD = 1 << 15
MERGE = 1 << 17

_REPLY, _TEXT = 0, 1


def _argmin_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value in each window."""
    least, place, size = values.copy(), np.arange(len(values)), 1

    def halves(shift: int):
        smaller = least[shift:] < least[:-shift]
        return np.where(smaller, least[shift:], least[:-shift]), np.where(smaller, place[shift:], place[:-shift])

    while 2 * size <= width:
        least, place = halves(size)
        size *= 2
    return halves(width - size)[1] if width > size else place


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, key: int = KEY) -> dict[str, np.ndarray]:
    """Snippets of a run of texts: text number, first byte, starts, place of the anchor, its hash."""
    n = len(data) - length + 1
    empty = np.empty(0, np.int64)
    if n <= 0:
        return {"text": empty, "first": empty, "starts": empty, "anchor": empty, "hash": empty.astype(np.uint64)}
    at = np.arange(len(data) - key + 1)
    hashes = range_hashes(data, at, at + key)
    place = _argmin_windows(hashes, length - key + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = text[:n] == text[length - 1 :]
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(change & inside)
    starts = np.bincount(np.cumsum(change & inside)[inside] - 1, minlength=len(first))
    return {"text": text[first], "first": first, "starts": starts, "anchor": place[first], "hash": hashes[place[first]]}


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(columns, types)], list(names))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], pa.RecordBatch | None]]:
    """(part, replies before the texts, some of the part's distinct texts), None at the end of a part."""
    part, replies, last = None, [], None
    for batch in batches:
        numbers = column(batch, "part").to_numpy()
        kinds = column(batch, "kind").to_numpy()
        for number in np.unique(numbers):
            if part != number:
                if part is not None:
                    yield part, replies, None
                part, replies, last = int(number), [], None
            a, b = np.searchsorted(numbers, [number, number + 1])
            middle = a + int(np.searchsorted(kinds[a:b], _TEXT))
            replies = replies + column(batch, "blob").slice(a, middle - a).to_pylist()
            if middle < b:
                own = batch.slice(middle, b - middle)
                for some in slices(own):
                    yield part, replies, some
    if part is not None:
        yield part, replies, None


def _fresh(some: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """The texts that differ from the one before them; equal ones are neighbours."""
    d, h = column(some, "d").to_numpy(), column(some, "h").to_numpy()
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    if len(d) and last == (d[0], h[0]):
        new[0] = False
    return (some if new.all() else some.filter(pa.array(new))), (d[-1], h[-1])


_ASKED = "part int, bucket int, keys binary, times binary"


def _report(buckets: int) -> Callable:
    """Step 1, parts: distinct anchors, and whether they occur once or more (up to HOT_IN_PART)."""

    def run(batches):
        keys, times, last = [], [], None
        for part, _, some in _runs(batches):
            if some is not None:
                some, last = _fresh(some, last)
                own, count = np.unique(anchors(*bytes_of(column(some, "text")))["hash"], return_counts=True)
                keys.append(own)
                times.append(count)
                continue
            key = np.concatenate([np.empty(0, np.uint64), *keys])
            count = np.concatenate([np.empty(0, np.int64), *times])
            key, back = np.unique(key, return_inverse=True)
            count = np.minimum(np.bincount(back, count, len(key)), HOT_IN_PART).astype(np.uint16)
            rows = [(part, b, pack_keys(key[own]), pack_numbers(count[own])) for b, own in _by_bucket(_bucket(key, buckets), buckets)]
            keys, times, last = [], [], None
            yield _batch(rows, _ASKED)

    return run


def _repeated(batches):
    """Step 1, buckets: anchors that occur twice or more, for each part that has them."""

    def flush(seen, blobs):
        key = np.concatenate([k for k, _ in seen])
        key, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, np.concatenate([c for _, c in seen]), len(key))
        parts = np.bincount(back, minlength=len(key))
        hot = (parts >= HOT_PARTS) | (count >= HOT_PARTS + HOT_IN_PART)
        at = 0
        for part, size in blobs:
            own = back[at : at + size]
            at += size
            own = own[count[own] > 1]
            if len(own):
                yield part, pack_table({"hash": key[own], "hot": hot[own]})

    bucket, seen, blobs = None, [], []
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if bucket != row["bucket"]:
                if seen:
                    rows.extend(flush(seen, blobs))
                bucket, seen, blobs = row["bucket"], [], []
            keys = unpack_keys(row["keys"])
            seen.append((keys, unpack_numbers(row["times"], np.uint16).astype(np.float64)))
            blobs.append((row["part"], len(keys)))
        yield _batch(rows, "part int, blob binary")
    if seen:
        yield _batch(list(flush(seen, blobs)), "part int, blob binary")


_SENT = "part int, bucket int, blob binary"


def _snippets(buckets: int, length: int = LENGTH) -> Callable:
    """Step 2: each part's snippets with shared anchors; bucket -1 holds starts that are settled."""

    def choose(some, table):
        data, bounds = bytes_of(column(some, "text"))
        found = anchors(data, bounds, length)
        at = np.minimum(np.searchsorted(table["hash"], found["hash"]), max(0, len(table["hash"]) - 1))
        hit = table["hash"][at] == found["hash"] if len(table["hash"]) else np.zeros(len(at), bool)
        found = {k: v[hit] for k, v in found.items()}
        hot = table["hot"][at[hit]]
        many = np.where(hot, found["starts"], 1)
        index = np.repeat(np.arange(len(many)), many)
        step = gathered(np.zeros(len(many), np.int64), many)
        first = found["first"][index] + step
        starts = np.where(hot[index], 1, found["starts"][index])
        size = starts + length - 1
        content = range_hashes(data, first, first + size)
        key = found["hash"][index]
        # Strings of a hot anchor meet by their own hash.
        key = np.where(hot[index], mix(key ^ content), key)
        text = found["text"][index]
        return {
            "key": key, "content": content,
            "d": column(some, "d").to_numpy()[text], "h": column(some, "h").to_numpy()[text],
            "start": first - bounds[text], "starts": starts, "anchor": found["anchor"][index] - first, "size": size,
        }, data[gathered(first, size)]

    def flush(part, tables, raw):
        if not tables:
            return _batch([], _SENT)
        rows = {k: np.concatenate([t[k] for t in tables]) for k in tables[0]}
        data = np.concatenate(raw)
        begin = np.cumsum(rows["size"]) - rows["size"]
        order = np.lexsort((rows["start"], rows["h"], rows["d"], rows["content"], rows["key"]))
        key, content = rows["key"][order], rows["content"][order]
        first = np.ones(len(order), bool)
        first[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        again, kept = order[~first], order[first]
        out = [(part, -1, _marks(rows["d"][again], rows["h"][again], rows["start"][again], rows["starts"][again]))]
        for b, own in _by_bucket(_bucket(rows["key"][kept], buckets), buckets):
            own = kept[own]
            blob = pack_table({k: rows[k][own] for k in ("key", "content", "d", "h", "start", "starts", "anchor", "size")})
            text = data[gathered(begin[own], rows["size"][own])]
            out.append((part, b, len(blob).to_bytes(8, "little") + blob + pack_numbers(text)))
        return _batch(out, _SENT)

    def run(batches):
        tables, raw, table, last = [], [], None, None
        for part, replies, some in _runs(batches):
            if some is None:
                yield flush(part, tables, raw)
                tables, raw, table, last = [], [], None, None
                continue
            if table is None:
                table = _joined(replies, {"hash": np.uint64, "hot": bool})
                order = np.argsort(table["hash"])
                table = {k: v[order] for k, v in table.items()}
            some, last = _fresh(some, last)
            rows, text = choose(some, table)
            tables.append(rows)
            raw.append(text)

    return run


def _joined(blobs: list[bytes], kinds: dict) -> dict[str, np.ndarray]:
    tables = [unpack_table(b) for b in blobs]
    return {k: np.concatenate([np.empty(0, kind), *[t[k].astype(kind) for t in tables]]) for k, kind in kinds.items()}


def _marks(d, h, start, starts) -> bytes:
    return pack_table({"d": d, "h": h, "start": start, "starts": starts})


def repeats(rows: dict[str, np.ndarray], data: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Snippet and start of all strings that occur earlier among these distinct snippets.

    Snippets of one anchor are numbered alike in ``rows["group"]`` and lie together.
    """
    begin = np.cumsum(rows["size"]) - rows["size"]
    depth = length - key + 1
    found_snippet, found_start = [], []
    at = 0
    size = rows["size"] - key + 2
    total = np.concatenate([[0], np.cumsum(size)])
    edges = np.append(np.flatnonzero(np.concatenate([[True], rows["group"][1:] != rows["group"][:-1]])), len(size))
    while at < len(size):
        # Whole groups up to MERGE symbols, one group at least.
        to = edges[max(np.searchsorted(edges, at, "right"), np.searchsorted(edges, np.searchsorted(total, total[at] + MERGE, "right") - 1, "right") - 1)]
        own = np.arange(at, to)
        left, right = rows["anchor"][own], rows["size"][own] - rows["anchor"][own] - key
        symbols = np.zeros(int(size[own].sum()), np.uint16)
        place = np.cumsum(size[own]) - size[own]
        symbols[gathered(place, left)] = data[gathered(begin[own], left)].astype(np.uint16) + 2
        symbols[place + left] = 1
        symbols[gathered(place + left + 1, right)] = data[gathered(begin[own] + rows["anchor"][own] + key, right)].astype(np.uint16) + 2
        snippet = np.repeat(own, size[own])
        start = gathered(np.zeros(len(own), np.int64), size[own])
        shard = (place // SHARD).astype(np.int64)
        transforms, suffixes = [], []
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            lo, hi = place[a], place[b] if b < len(place) else len(symbols)
            text, lengths = symbols[lo:hi], size[own[a:b]]
            order = bwt.suffix_order(text, lengths)
            transforms.append(bwt.transform(text, lengths, order))
            suffixes.append(order + lo)
        merged, prefix = bwt.merge(transforms, depth)
        position = np.concatenate(suffixes)[merged]
        interval = np.cumsum(prefix < depth)
        good = start[position] < rows["starts"][snippet[position]]
        position, interval = position[good], interval[good]
        owner = snippet[position]
        begins = rows["start"][owner] + start[position]
        order = np.lexsort((begins, rows["h"][owner], rows["d"][owner], rows["group"][owner], interval))
        owner, interval, offset = owner[order], interval[order], start[position][order]
        later = np.zeros(len(order), bool)
        later[1:] = (interval[1:] == interval[:-1]) & (rows["group"][owner][1:] == rows["group"][owner][:-1])
        found_snippet.append(owner[later])
        found_start.append(offset[later])
        at = to
    return np.concatenate([np.empty(0, np.int64), *found_snippet]), np.concatenate([np.empty(0, np.int64), *found_start])


class _Pool:
    """Distinct snippets of a bucket, the first occurrence of each, merged blob by blob."""

    def __init__(self) -> None:
        self.rows: dict[str, np.ndarray] | None = None
        self.data = np.empty(0, np.uint8)
        self.waiting: list[tuple[dict[str, np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, part: int, blob: bytes) -> list[tuple]:
        """Take one part's snippets; merges when as many wait as are held."""
        cut = int.from_bytes(blob[:8], "little") + 8
        rows = unpack_table(blob[8:cut])
        rows["part"] = np.full(len(rows["key"]), part)
        self.waiting.append((rows, unpack_numbers(blob[cut:], np.uint8)))
        self.size += len(rows["key"])
        held = 0 if self.rows is None else len(self.rows["key"])
        return self.merge() if self.size > max(1 << 16, held) else []

    def merge(self) -> list[tuple]:
        """Keep the first of equal snippets; returns marks of the other occurrences."""
        tables = [t for t, _ in self.waiting] + ([] if self.rows is None else [self.rows])
        rows = {k: np.concatenate([t[k] for t in tables]) for k in tables[0]}
        data = np.concatenate([x for _, x in self.waiting] + ([] if self.rows is None else [self.data]))
        self.waiting, self.size = [], 0
        begin = np.cumsum(rows["size"]) - rows["size"]
        order = np.lexsort((rows["start"], rows["h"], rows["d"], rows["content"], rows["size"], rows["key"]))
        same = np.ones(len(order), bool)
        for name in ("key", "size", "content"):
            value = rows[name][order]
            same[1:] &= value[1:] == value[:-1]
        same[:1] = False
        gone = order[same]
        kept = order[~same]
        self.data = data[gathered(begin[kept], rows["size"][kept])]
        self.rows = {k: v[kept] for k, v in rows.items()}
        return _marks_by_part({k: v[gone] for k, v in rows.items()})

    def solve(self) -> list[tuple]:
        """Marks of all occurrences that are not the first, and of strings that another snippet has earlier."""
        marks_before = self.merge() if self.waiting else []
        rows = self.rows
        begin = np.cumsum(rows["size"]) - rows["size"]
        # Anchors of equal hash are told apart by their bytes.
        bytes_ = [self.data[b : b + KEY].tobytes() for b in (begin + rows["anchor"]).tolist()]
        names: dict[tuple, int] = {}
        group = np.array([names.setdefault(x, len(names)) for x in zip(rows["key"].tolist(), bytes_)], np.int64)
        shared = np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.empty(0, np.int64)
        order = shared[np.argsort(group[shared], kind="stable")]
        if not len(order):
            return marks_before
        own = {k: v[order] for k, v in rows.items()} | {"group": group[order]}
        snippet, start = repeats(own, self.data[gathered(begin[order], own["size"])])
        marks = {k: own[k][snippet] for k in ("part", "d", "h", "start")}
        marks["start"] = marks["start"] + start
        marks["starts"] = np.ones(len(start), np.int64)
        return marks_before + _marks_by_part(marks)


def _marks_by_part(marks: dict[str, np.ndarray]) -> list[tuple]:
    out = []
    order = np.lexsort((marks["start"], marks["h"], marks["d"], marks["part"]))
    marks = {k: v[order] for k, v in marks.items()}
    for part in np.unique(marks["part"]).tolist():
        a, b = np.searchsorted(marks["part"], [part, part + 1])
        out.append((part, _marks(*[marks[k][a:b] for k in ("d", "h", "start", "starts")])))
    return out


def _solved(batches):
    """Step 3: marks of each bucket's repeats, by part."""
    bucket, pool = None, _Pool()
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if bucket != row["bucket"]:
                if bucket is not None:
                    rows.extend(pool.solve())
                bucket, pool = row["bucket"], _Pool()
            rows.extend(pool.add(row["part"], row["blob"]))
        yield _batch(rows, "part int, blob binary")
    if bucket is not None:
        yield _batch(pool.solve(), "part int, blob binary")


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(length: int = LENGTH) -> Callable:
    """Step 4: remove the marked strings; without a mark the text stays as it is."""

    def cut(raw: bytes, start: np.ndarray, starts: np.ndarray) -> tuple[int, int, str]:
        depth = np.zeros(len(raw) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + starts + length - 1, -1)
        gone = np.cumsum(depth)[:-1] > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()

    def run(batches):
        marks, part_now = None, None
        for part, replies, some in _runs(batches):
            if some is None:
                marks = None
                continue
            if marks is None or part_now != part:
                marks = _joined(replies, {k: np.int64 for k in ("d", "h", "start", "starts")})
                order = np.lexsort((marks["start"], marks["h"], marks["d"]))
                marks = {k: v[order] for k, v in marks.items()}
                part_now = part
            data, bounds = bytes_of(column(some, "text"))
            raw, rows = data.tobytes(), []
            ids, d, h = (column(some, n).to_pylist() for n in ("doc_id", "d", "h"))
            near = np.searchsorted(marks["d"], d)
            past = np.searchsorted(marks["d"], d, "right")
            for i, (lo, hi) in enumerate(zip(near.tolist(), past.tolist())):
                text = raw[bounds[i] : bounds[i + 1]]
                if lo < hi:
                    own = slice(lo + int(np.searchsorted(marks["h"][lo:hi], h[i])), lo + int(np.searchsorted(marks["h"][lo:hi], h[i], "right")))
                    if own.start < own.stop:
                        rows.append((ids[i], len(text), *cut(text, marks["start"][own], marks["starts"][own])))
                        continue
                rows.append((ids[i], len(text), 0, 0, hashlib.sha256(text).hexdigest()))
            yield _batch(rows, _RESULT)

    return run


def remove_repeats(docs: DataFrame, part_bytes: int = PART_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of doc_id and text."""
    stage = Stage(docs.sparkSession, "substring-dedup")
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    buckets = max(buckets, 8 * math.isqrt(parts))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    texts = docs.select(
        F.lit(_TEXT).alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), d.alias("d"),
        F.xxhash64(text).alias("h"), text.alias("text"), F.lit(None).cast("binary").alias("blob"),
    ).withColumn("part", F.pmod(F.xxhash64("d", "h"), F.lit(parts)).cast("int"))

    def with_texts(replies: DataFrame | None) -> DataFrame:
        rows = texts
        if replies is not None:
            rows = replies.select("part", "blob", F.lit(_REPLY).alias("kind")).unionByName(texts, allowMissingColumns=True)
        rows = rows.select("part", "kind", "doc_id", "d", "h", "text", "blob")
        return rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "d", "h")

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket", "part")

    asked = stage.keep(with_texts(None).mapInArrow(_report(buckets), _ASKED))
    shared = stage.keep(by_bucket(asked).mapInArrow(_repeated, "part int, blob binary"))
    stage.drop(asked)
    sent = stage.keep(with_texts(shared).mapInArrow(_snippets(buckets), _SENT))
    stage.drop(shared)
    settled = sent.where("bucket < 0").select("part", "blob")
    found = by_bucket(sent.where("bucket >= 0")).mapInArrow(_solved, "part int, blob binary")
    marks = stage.keep(settled.union(found))
    stage.drop(sent)
    return with_texts(marks).mapInArrow(_cut_out(), _RESULT)
