"""Repeated line runs by a suffix array over line ids.

Documents are sequences of line ids (lines without a word take no part). The
suffixes of all sequences are ranked by distributed prefix doubling: ranks by
2^k lines are made of two ranks by 2^(k-1), and suffixes that are already alone
drop out. Suffixes of one rank form an interval with that common prefix. A run
is a stretch of lines with at least ``min_words`` words in all; every copy of a
run but the first (least doc_id, then place) is deleted. Runs overlap into the
maximal repeated ones, so a line goes if and only if a run over it occurs
earlier.

A run needs no more lines than words, so runs of the least size settle which
lines go: those that begin at a line and those that end at it. They are ranked
by the suffix ranks of their two power-of-two ends.

Defined cases: a null text stays null, an empty one empty; null doc_ids come
first; rows with equal doc_id and text are one document and get equal results;
an empty table gives an empty result. A document that loses all its lines stays,
with an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import bytes_of, column, slices, tidy
from usageloom.llm.staging import Stage, ordered_ranks, packed, unpacked
from usageloom.llm.textstats import Words, lines

#: Words of the shortest run that is deleted.
MIN_WORDS = 8

_LINES = "d long, h long, seq int, line int, a long, b long, ahead int, behind int"


def _keys() -> list[Column]:
    """A document's key: doc_id (the least long for null) and a hash of its text."""
    least = F.lit(-(1 << 63)).cast("long")
    return [F.coalesce(F.col("doc_id").cast("long"), least).alias("d"), F.xxhash64("text").alias("h")]


def line_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line with a word: its id (a, b) and the lines that a least run takes.

    ``ahead`` lines from here on, or ``behind`` lines up to here, hold at least
    ``min_words`` words; 0 where the document ends before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, bounds = bytes_of(column(part, "text"))
                words = Words(data, bounds)
                starts, ends, text = lines(words)
                before = np.searchsorted(words.starts, starts)
                count = np.searchsorted(words.starts, ends) - before
                number = np.arange(len(starts)) - np.searchsorted(text, text)
                full = np.flatnonzero(count)
                text, number, count, starts, ends = (x[full] for x in (text, number, count, starts, ends))
                seq = np.arange(len(full)) - np.searchsorted(text, text)
                total = np.concatenate([[0], np.cumsum(count)])
                here = np.arange(len(full))
                last = np.searchsorted(text, text, "right")
                stop = np.searchsorted(total, total[here] + min_words)
                ahead = np.where(stop <= last, stop - here, 0)
                first = np.searchsorted(text, text)
                begin = np.searchsorted(total, total[here + 1] - min_words, "right") - 1
                behind = np.where((begin >= first) & (total[here + 1] - total[first] >= min_words), here + 1 - begin, 0)
                raw = data.tobytes()
                digest = xxhash.xxh3_128_digest
                ids = np.frombuffer(
                    b"".join([digest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]), "<i8"
                ).reshape(-1, 2)
                d, h = column(part, "d").to_numpy(), column(part, "h").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d[text]), pa.array(h[text]), pa.array(seq.astype(np.int32)),
                        pa.array(number.astype(np.int32)), pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()),
                        pa.array(ahead.astype(np.int32)), pa.array(behind.astype(np.int32)),
                    ],
                    [c.split()[0] for c in _LINES.split(", ")],
                )

    texts = docs.select(*_keys(), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(run), _LINES)


def suffix_ranks(stage: Stage, rows: DataFrame, longest: int) -> list[DataFrame]:
    """(d, h, seq, rank) by the first 1, 2, 4 .. lines, for suffixes that share them with another.

    Ranks order the suffixes: equal ranks are equal prefixes, a lower rank is a
    smaller prefix. Counts are taken before any shuffle of equal keys.
    """

    def ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
        shared = pairs.groupBy(*by).count().where("count > 1").select(*by)
        ranks = ordered_ranks(stage, shared, by, "place")
        return stage.keep(pairs.join(ranks, by).select("d", "h", "seq", F.col("place").alias("rank")))

    levels = [ranked(rows.select("d", "h", "seq", "a", "b"), ["a", "b"])]
    size = 1
    while 2 * size <= longest:
        now = levels[-1]
        after = now.select("d", "h", (F.col("seq") - size).alias("seq"), F.col("rank").alias("next"))
        levels.append(ranked(now.join(after, ["d", "h", "seq"]), ["rank", "next"]))
        size *= 2
    return levels


def later_copies(stage: Stage, rows: DataFrame, min_words: int) -> DataFrame:
    """(d, h, first, count): least runs, as line sequence numbers, that occur earlier."""
    levels = suffix_ranks(stage, rows, min_words)
    begin = rows.where("ahead > 0").select("d", "h", "seq", F.col("ahead").alias("n"))
    end = rows.where("behind > 0").select(
        "d", "h", (F.col("seq") - F.col("behind") + 1).alias("seq"), F.col("behind").alias("n")
    )
    runs = stage.keep(begin.union(end).distinct())
    found = None
    for k, level in enumerate(levels):
        size = 1 << k
        tail = level.select("d", "h", F.col("seq").alias("last"), F.col("rank").alias("tail"))
        own = (
            runs.where((F.col("n") >= size) & (F.col("n") < 2 * size))
            .join(level, ["d", "h", "seq"])
            .withColumn("last", F.col("seq") + F.col("n") - size)
            .join(tail, ["d", "h", "last"])
            .select("d", "h", "seq", "n", "rank", "tail")
        )
        found = own if found is None else found.union(own)
    found = stage.keep(found)
    first = found.groupBy("n", "rank", "tail").agg(
        F.min(F.struct("d", "h", "seq")).alias("first"), F.count("*").alias("copies")
    )
    repeated = found.join(first.where("copies > 1"), ["n", "rank", "tail"])
    return repeated.where(F.struct("d", "h", "seq") > F.col("first")).select("d", "h", "seq", "n")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All documents, text without later copies of line runs, and removed_lines (an array)."""
    stage = Stage(docs.sparkSession, "line-dedup", shuffled=True)
    rows = stage.keep(line_rows(docs, min_words).dropDuplicates(["d", "h", "seq"]))
    gone = later_copies(stage, rows, min_words)
    covered = gone.select("d", "h", F.explode(F.expr("sequence(seq, seq + n - 1)")).alias("seq")).distinct()
    removed = stage.keep(
        rows.join(covered, ["d", "h", "seq"]).groupBy("d", "h").agg(F.sort_array(F.collect_list("line")).alias("removed_lines"))
    )
    stage.leave(removed)
    joined = packed(docs, *_keys(), F.col("text")).join(removed, ["d", "h"], "left")
    rows = joined.select("row", "text", F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))
    return unpacked(_cut(rows), "text", "removed_lines").select(
        *[c for c in docs.columns if c != "removed_lines"], "removed_lines"
    )


def _cut(rows: DataFrame) -> DataFrame:
    """Take removed_lines out of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            for at, removed in enumerate(column(batch, "removed_lines").to_pylist()):
                if removed:
                    gone = set(removed)
                    texts[at] = "\n".join(x for i, x in enumerate(texts[at].split("\n")) if i not in gone)
            index = batch.schema.get_field_index("text")
            yield batch.set_column(index, "text", pa.array(texts, batch.schema.field(index).type))

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, removed_lines array<int>"
    return rows.mapInArrow(tidy(run), schema)
