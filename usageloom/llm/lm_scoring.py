"""Scores of texts under a context-tree model that is learned from the corpus.

The model is as large as the corpus makes it and is never sent around whole.
Documents are dealt into parts by a hash. Each part asks for the distinct codes
and words of its texts, with its training counts, in one compressed blob per
bucket; a bucket adds up what all parts say, weights its subtrees, and answers
each part with the values of just what it asked for. A code travels once per
part, not once per place in a text.

A bucket streams over its blobs and holds its distinct codes only; contexts of
two bytes bound them, and words are spread by hash. The two depths above the
buckets are 65,792 numbers at any corpus size.

Modelled text: the lower-cased words (A-Z only), joined by one space, and an end.

Defined cases: a null text is empty and has the end alone; a null doc_id counts
as the empty text in the folds; repeated rows are learned from as often as they
occur and score alike; without training rows all estimates are even; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm import context_tree as ct
from usageloom.llm.arrays import (
    bytes_of,
    column,
    mix,
    pack_keys,
    pack_numbers,
    slices,
    unpack_keys,
    unpack_numbers,
)
from usageloom.llm.staging import Stage
from usageloom.llm.textstats import Words

#: Bytes of text in a part.
PART_BYTES = 12 << 20
#: Least number of buckets; it grows with the square root of the parts, so that blobs stay worth sending.
BUCKETS = 64
CODES, WORDS, TEXTS = 1, 2, 3
_END = b"\n"


class Texts:
    """A slice of texts in modelled form: codes by text, and word hashes by text."""

    def __init__(self, part: pa.RecordBatch, depth: int):
        raw, bounds = bytes_of(column(part, "text"))
        raw, cut = raw.tobytes(), bounds.tolist()
        pad = _END * depth
        plain = [b" ".join(raw[a:b].lower().split()) for a, b in zip(cut, cut[1:])]
        data = np.frombuffer(b"".join([pad + p + _END for p in plain]), np.uint8)
        self.lengths = np.fromiter((len(p) + 1 for p in plain), np.int64, len(plain))
        ends = np.cumsum(self.lengths + depth)
        skip = np.zeros(len(data), bool)
        for k in range(depth):
            skip[ends - self.lengths - depth + k] = True
        self.codes = ct.codes(data, skip, depth)
        words = Words(data, np.concatenate([[0], ends]))
        self.words = words.hashes()
        self.word_count = words.count
        self.word_cuts = words.cuts

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of values given per code."""
        return np.add.reduceat(values, np.cumsum(self.lengths) - self.lengths)

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[self.word_cuts[1:]] - total[self.word_cuts[:-1]]


def bucket_of(keys: np.ndarray, kind: int, buckets: int, depth: int) -> np.ndarray:
    """Codes go by their LOCAL nearest context bytes, so that subtrees stay whole."""
    if kind == CODES:
        keys = mix(keys >> np.uint64(8 * (depth + 1 - ct.LOCAL)))
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class _Tally:
    """Distinct keys of one part and their training counts, merged slice by slice."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > 1 << 21:
            self.merge()
            self.size = 0

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        merged = ct.summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts = [merged[0]], [merged[1]]
        return merged


def _count(tally: _Tally, keys: np.ndarray, learn: np.ndarray) -> None:
    """Add occurrences; those not learned from only make the key known."""
    both = np.sort(keys << np.uint64(1) | learn.astype(np.uint64)) if not len(keys) or keys.max() >> np.uint64(63) == 0 else None
    if both is None:
        tally.add(*ct.summed(keys, learn.astype(np.int64)))
        return
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(both)))
    found = both[first]
    tally.add(found >> np.uint64(1), np.where(found & np.uint64(1), times, 0).astype(np.int64))


_REQUEST = "part int, kind int, bucket int, keys binary, counts binary, docs long, tokens long"


def _requests(texts: DataFrame, buckets: int, depth: int) -> DataFrame:
    """What each part asks for; rows of kind 0 hold its training documents and tokens."""

    def flush(part: int, tallies: dict[int, _Tally], docs: int, tokens: int) -> pa.RecordBatch:
        rows = [(part, 0, 0, b"", b"", docs, tokens)]
        for kind, tally in tallies.items():
            keys, counts = tally.merge()
            bucket = bucket_of(keys, kind, buckets, depth)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    rows.append((part, kind, b, pack_keys(keys[own]), pack_numbers(counts[own]), 0, 0))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = ["part", "kind", "bucket", "keys", "counts", "docs", "tokens"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tallies, docs, tokens = None, {}, 0, 0
        for batch in batches:
            numbers = column(batch, "part").to_numpy()
            for number in np.unique(numbers):
                if part != number:
                    if part is not None:
                        yield flush(part, tallies, docs, tokens)
                    part, tallies, docs, tokens = int(number), {CODES: _Tally(), WORDS: _Tally()}, 0, 0
                a, b = np.searchsorted(numbers, [number, number + 1])
                for some in slices(batch.slice(a, b - a)):
                    own = Texts(some, depth)
                    learn = ~column(some, "held_out").to_numpy(zero_copy_only=False).astype(bool)
                    _count(tallies[CODES], own.codes, np.repeat(learn, own.lengths))
                    _count(tallies[WORDS], own.words, np.repeat(learn, own.word_count))
                    docs += int(learn.sum())
                    tokens += int((own.word_count[learn] + 1).sum())
        if part is not None:
            yield flush(part, tallies, docs, tokens)

    return texts.mapInArrow(run, _REQUEST)


_MERGED = "kind int, bucket int, keys binary, counts binary, known long, top_key binary, top_counts binary, top_weighted binary"


def _merged(requests: DataFrame, depth: int) -> DataFrame:
    """Per bucket, the counts of all parts together and the tops of its subtrees."""

    def flush(kind: int, bucket: int, tally: _Tally) -> pa.RecordBatch:
        keys, counts = tally.merge()
        row = [kind, bucket, pack_keys(keys), pack_numbers(counts), int((counts > 0).sum()), None, None, None]
        if kind == CODES:
            trees = ct.build(keys, counts, depth)
            row[5:] = [x.tobytes() for x in (trees.top_key, trees.top_counts, trees.top_weighted)]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = ["kind", "bucket", "keys", "counts", "known", "top_key", "top_counts", "top_weighted"]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tally = None, _Tally()
        for batch in batches:
            for row in batch.to_pylist():
                if at != (row["kind"], row["bucket"]):
                    if at is not None:
                        yield flush(*at, tally)
                    at, tally = (row["kind"], row["bucket"]), _Tally()
                tally.add(unpack_keys(row["keys"]), unpack_numbers(row["counts"], np.int64))
        if at is not None:
            yield flush(*at, tally)

    asked = requests.where("kind > 0").select("kind", "bucket", "part", "keys", "counts")
    return asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "part").mapInArrow(run, _MERGED)


def _replies(requests: DataFrame, merged: DataFrame, top: ct.Crown, depth: int) -> DataFrame:
    """For each part and bucket, the keys asked for and their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = values = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                asked = unpack_keys(row["keys"])
                if row["part"] < 0:
                    keys = asked
                    values = unpack_numbers(row["counts"], np.int64)
                    if row["kind"] == CODES:
                        values = ct.log10_probability(keys, ct.build(keys, values, depth), top, depth)
                else:
                    found = values[np.searchsorted(keys, asked)].astype(np.float64)
                    out.append((row["part"], row["kind"], row["keys"], pack_numbers(found)))
            if out:
                names, types = ["part", "kind", "keys", "counts"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    sums = merged.select("kind", "bucket", F.lit(-1).alias("part"), "keys", "counts")
    asked = requests.where("kind > 0").select("kind", "bucket", "part", "keys", "counts")
    return (
        sums.union(asked)
        .repartition("kind", "bucket")
        .sortWithinPartitions("kind", "bucket", "part")
        .mapInArrow(run, "part int, kind int, keys binary, counts binary")
    )


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _scored(texts: DataFrame, replies: DataFrame, parts: int, totals: tuple[int, int, int], depth: int) -> DataFrame:
    """Add up the values of each text; a part's replies come before its texts."""
    train_docs, train_tokens, vocabulary = totals
    floor = train_tokens + 0.5 * (vocabulary + 1)

    def score(some: pa.RecordBatch, tables: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        own = Texts(some, depth)
        keys, values = tables[CODES]
        total = own.sums(values[np.searchsorted(keys, own.codes)])
        if len(own.words):
            keys, values = tables[WORDS]
            count = values[np.searchsorted(keys, own.words)]
        else:
            count = np.empty(0)
        base = own.word_sums(np.log10((count + 0.5) / floor)) + np.log10((train_docs + 0.5) / floor)
        known = own.word_sums((count > 0).astype(np.float64)).round().astype(np.int64) + (train_docs > 0)
        n = some.num_rows
        arrays = [
            column(some, "doc_id"), column(some, "held_out"), pa.array(own.word_count + 1), pa.array(known),
            pa.array(np.full(n, train_tokens)), pa.array(base), pa.array(total),
            pa.array(-total * np.log2(10.0) / own.lengths),
        ]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _SCORES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, heard, tables = None, {}, None
        for batch in batches:
            numbers, kinds = column(batch, "part").to_numpy(), column(batch, "kind").to_numpy()
            for number in np.unique(numbers):
                if part != number:
                    part, heard, tables = number, {CODES: [], WORDS: []}, None
                a, b = np.searchsorted(numbers, [number, number + 1])
                middle = a + int(np.searchsorted(kinds[a:b], TEXTS))
                for row in batch.slice(a, middle - a).select(["kind", "keys", "counts"]).to_pylist():
                    heard[row["kind"]].append((unpack_keys(row["keys"]), unpack_numbers(row["counts"], np.float64)))
                if middle < b and tables is None:
                    tables = {}
                    for kind, blobs in heard.items():
                        keys = np.concatenate([k for k, _ in blobs]) if blobs else np.empty(0, np.uint64)
                        values = np.concatenate([v for _, v in blobs]) if blobs else np.empty(0)
                        order = np.argsort(keys)
                        tables[kind] = (keys[order], values[order])
                    heard = {CODES: [], WORDS: []}
                for some in slices(batch.slice(middle, b - middle)):
                    yield score(some, tables)

    rows = texts.select("part", F.lit(TEXTS).alias("kind"), "doc_id", "held_out", "text").withColumns(
        {"keys": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")}
    )
    answers = replies.select(
        "part", "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"),
        F.lit(None).cast("string").alias("text"), "keys", "counts",
    )
    return (
        answers.union(rows).repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(run, _SCORES)
    )


def score_texts(docs: DataFrame, part_bytes: int = PART_BYTES, buckets: int = BUCKETS, depth: int = ct.DEPTH) -> DataFrame:
    """Scores of all rows of doc_id, held_out and text; rows held out are not learned from."""
    spark = docs.sparkSession
    stage = Stage(spark, "lm-scoring")
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    buckets = max(buckets, 4 * math.isqrt(parts))
    texts = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("held_out", F.lit(False)).alias("held_out"),
        text.alias("text"),
    )
    dealt = texts.repartition(parts, "part").sortWithinPartitions("part")
    requests = stage.keep(_requests(dealt, buckets, depth))
    merged = stage.keep(_merged(requests, depth))
    train_docs, train_tokens = requests.agg(F.sum("docs"), F.sum("tokens")).first()
    words = merged.where(F.col("kind") == WORDS).agg(F.sum("known")).first()[0] or 0
    # Nodes of contexts of LOCAL bytes: at most 65,536 contexts of 255 nodes at any corpus size.
    tops = merged.where(F.col("kind") == CODES).select("top_key", "top_counts", "top_weighted").collect()
    keys = [np.frombuffer(t.top_key, np.uint64) for t in tops]
    crown = ct.crown(
        np.concatenate([np.empty(0, np.uint64), *keys]),
        np.concatenate([np.empty((2, 0)), *[np.frombuffer(t.top_counts).reshape(2, -1) for t in tops]], axis=1),
        np.concatenate([np.empty(0), *[np.frombuffer(t.top_weighted) for t in tops]]),
    )
    totals = (train_docs or 0, train_tokens or 0, words + (1 if train_docs else 0))
    return _scored(texts, _replies(requests, merged, crown, depth), parts, totals, depth)
