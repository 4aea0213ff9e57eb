"""Token packing by the sum-of-squares rule.

Documents become token ids and an end id; only documents longer than a sequence
are cut. Pieces are dealt into groups of bounded size that are packed apart from
each other. Inside a group each piece, longest first, goes where the sum of the
squared numbers of open bins per residual gap becomes least, once with a new bin
as a free choice and once as the last resort, and the better packing is taken.
At the end the emptiest open bins are dissolved while their pieces fit elsewhere.

Defined cases: a null or empty text is a document of the end id alone; repeated
rows are packed as often as they occur; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import column, slices, tidy
from usageloom.llm.staging import Stage

CAPACITY = 4096
END = 1
#: Pieces packed together by one task.
GROUP_PIECES = 1 << 15
#: A worker keeps the token ids of about so many distinct parts of words, and of those used before them.
CACHE_PARTS = 500_000
#: Bytes of text cut into words at once.
TEXT_BYTES = 8 << 20

#: Characters that are not Latin-1, whose text is its own composed form, or may be white space beyond ASCII's.
_ODD = r"[^\x{00}-\x{1b}\x{20}-\x{84}\x{86}-\x{9f}\x{a1}-\x{ff}]"
#: Leads a word that is encoded whole; no word holds white space.
_WHOLE = "\n"

_workers: dict[str, WordEncoder] = {}


def _as_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Ids of the words between ASCII white space, a batch of texts at a time.

    The tokenizer lower-cases, splits by a pattern that never spans white space
    and merges each part by itself. Arrow cuts texts into words and their distinct
    words into parts, by the tokenizer's own pattern; only distinct parts are merged,
    with the tokenizer's byte letters and merge model. That holds for words of
    Latin-1 characters; words with other characters, odd white space or special
    tokens are one part that goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        split = json.loads(self.whole.pre_tokenizer.__getstate__())["pretokenizers"][0]
        self.pattern = split["pattern"]["Regex"]
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # Printable ASCII stands for itself.
        self.letters = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
        special = (re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values())
        self.odd = "|".join((_ODD, *special))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        return _as_bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if part.startswith(_WHOLE):
            return self.encode(part[1:])
        plain = part.isascii() and part.isprintable()
        return _as_bytes([t.id for t in self.merge(part if plain else part.translate(self.letters))])

    def _ids(self, parts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_PARTS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, parts))
        for at, part in enumerate(parts):
            if found[at] is None:
                ids = self.older.get(part)
                self.known[part] = found[at] = self._part(part) if ids is None else ids
        return found

    def _parts(self, words: pa.Array) -> pa.ListArray:
        """The parts of each word; empty ones may be among them."""
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(words, self.odd)
        parts = pc.utf8_lower(words)
        cut = pc.invert(pc.or_(odd, pc.utf8_is_alpha(words)))
        parts = pc.replace_with_mask(parts, cut, pc.replace_substring_regex(parts.filter(cut), self.pattern, "\\0 "))
        whole = words.filter(odd)
        marks = pa.array([_WHOLE], whole.type).take(pa.array(np.zeros(len(whole), np.int32)))
        parts = pc.replace_with_mask(parts, odd, pc.binary_join_element_wise(marks, whole, pa.scalar("", whole.type)))
        return pc.split_pattern(parts, " ")

    def _words(self, words: pa.Array) -> pa.LargeListArray:
        """The ids of each word."""
        parts = self._parts(words)
        each = parts.flatten().dictionary_encode()
        ids = self._ids(each.dictionary.to_pylist())
        ends = np.cumsum([0, *map(len, ids)]) // 4
        ids = pa.LargeListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<u4")).take(each.indices)
        return pa.LargeListArray.from_arrays(ids.offsets.take(parts.offsets), ids.flatten())

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        # Imported by workers alone: the driver does without it.
        import pyarrow.compute as pc

        words = pc.ascii_split_whitespace(texts)
        each = words.flatten().dictionary_encode()
        ids = self._words(each.dictionary).take(each.indices)
        ends = (4 * ids.offsets.to_numpy()[words.offsets.to_numpy()]).tolist()
        raw = ids.flatten().to_numpy().view(np.uint8)
        return [raw[first:last].tobytes() for first, last in zip(ends, ends[1:])]


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def token_bytes(path: str, texts: list[str] | pa.Array) -> list[bytes]:
    return encoder(path).texts(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, a key of the text, piece, start, length, ids_crc32."""
    end = END.to_bytes(4, "little")
    schema = "doc_id long, text_key long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "text_key", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=TEXT_BYTES):
                rows: list[list] = [[], [], [], [], [], []]
                ids, keys = column(part, "doc_id").to_pylist(), column(part, "text_key").to_pylist()
                for doc, key, raw in zip(ids, keys, token_bytes(tokenizer_path, column(part, "text"))):
                    raw += end
                    for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[at : at + 4 * capacity]
                        for held, value in zip(rows, (doc, key, n, at // 4, len(cut) // 4, zlib.crc32(cut))):
                            held.append(value)
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types)], names)

    texts = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.mapInArrow(tidy(run), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers; items are taken longest first.

    Packed twice, with a new bin as a choice at any time, and as the last
    resort only; the packing of fewer bins is kept.
    """
    return min((_packed(lengths, capacity, free) for free in (True, False)), key=len)


def _packed(lengths: np.ndarray, capacity: int, free: bool) -> list[list[int]]:
    open_bins = np.zeros(capacity + 1, np.int64)
    at_gap: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    gaps: list[int] = []
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        left = capacity - size
        here = open_bins[size:capacity]
        cost = 2 * (open_bins[0 : capacity - size] - here) + 2
        if len(cost):
            cost[0] = 1 - 2 * here[0]
        cost = np.where(here > 0, cost, np.iinfo(np.int64).max)
        best = int(np.argmin(cost)) if len(cost) else 0
        fresh = 2 * int(open_bins[left]) + 1 if left else 0
        if not len(cost) or not here[best] or (free and cost[best] > fresh):
            chosen = len(bins)
            bins.append([])
            gaps.append(capacity)
        else:
            gap = size + best
            chosen = at_gap[gap].pop()
            open_bins[gap] -= 1
        bins[chosen].append(item)
        gaps[chosen] -= size
        if gaps[chosen]:
            at_gap.setdefault(gaps[chosen], []).append(chosen)
            open_bins[gaps[chosen]] += 1
    return _dissolve(bins, gaps, lengths)


def _dissolve(bins: list[list[int]], gaps: list[int], lengths: np.ndarray) -> list[list[int]]:
    """Empty the bins with the largest gaps while every piece of theirs fits another open bin."""
    room = sorted((gap, b) for b, gap in enumerate(gaps) if gap)
    while room:
        gap, victim = room.pop()
        moves = []
        for item in sorted(bins[victim], key=lambda i: -lengths[i]):
            at = bisect_left(room, (int(lengths[item]), -1))
            if at == len(room):
                break
            space, target = room.pop(at)
            moves.append((item, target, space))
            if space > lengths[item]:
                insort(room, (space - int(lengths[item]), target))
        if len(moves) < len(bins[victim]):
            for item, target, space in reversed(moves):
                after = space - int(lengths[item])
                if after:
                    room.remove((after, target))
                insort(room, (space, target))
            break
        for item, target, _ in moves:
            bins[target].append(item)
        bins[victim] = []
    return [own for own in bins if own]


def pack(rows: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces; ``groups`` packs are filled side by side."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = [("doc_id", "ascending"), ("piece", "ascending"), ("text_key", "ascending")]
        table = table.sort_by(order)
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for number, own in enumerate(sum_of_squares(lengths, capacity)):
            sequence[own] = (key[0].as_py() << 32) | number
            offset[own] = np.cumsum(lengths[own]) - lengths[own]
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).drop(["grp"])

    grp = F.pmod(F.xxhash64("doc_id", "text_key", "piece"), F.lit(groups)).alias("grp")
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", sequence_id long, offset long"
    return rows.select("*", grp).groupBy("grp").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place."""
    staged = Stage(docs.sparkSession, "packing").keep(pieces(docs, tokenizer_path, capacity))
    groups = max(1, -(-staged.count() // GROUP_PIECES))
    return pack(staged, groups, capacity).drop("text_key")
