import hashlib
import random

import numpy as np
import pytest

from cases import CLASHING, prose
from usageloom.llm import bwt, decontamination, line_dedup, substring_dedup


def ordered(texts):
    """Distinct documents in the order that decides which copy is the first; ties never matter here."""
    return sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0))


def plain_lines(texts, min_words):
    seen, out = set(), {}
    for d, t in ordered(texts):
        rows = [(i, x) for i, x in enumerate((t or "").split("\n")) if x.split()]
        gone, fresh = set(), []
        for a in range(len(rows)):
            words = 0
            for b in range(a, min(len(rows), a + min_words)):
                words += len(rows[b][1].split())
                run = tuple(x for _, x in rows[a : b + 1])
                if words >= min_words:
                    if run in seen:
                        gone |= {i for i, _ in rows[a : b + 1]}
                    seen.add(run)
        out[d, t] = sorted(gone)
    return out


def test_line_runs_equal_brute_force(make_docs, odd_texts):
    pick = random.Random(4)
    pool = [prose(i, pick.choice([1, 2, 3, 9])).replace("\n", " ") for i in range(12)] + [""]
    texts = [x for x in odd_texts if x[0] is not None or x[1]] + [(100 + i, "\n".join(pick.choice(pool) for _ in range(pick.randint(0, 9)))) for i in range(40)]
    docs = make_docs(texts, clash=True)
    for min_words in (1, 5, 8):
        out = line_dedup.without_repeats(docs, min_words)
        want = plain_lines(texts, min_words)
        rows = out.collect()
        assert len(rows) == len(texts)
        left = {}
        for (d, t), gone in want.items():
            kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
            left.setdefault((d, tuple(gone)), set()).add(kept)
        for r in rows:
            assert r.text in left[r.doc_id, tuple(r.removed_lines)]
    assert set(CLASHING) <= set(out.columns)
    assert line_dedup.without_repeats(make_docs([])).count() == 0


def plain_substrings(texts, length=100):
    seen, out = set(), {}
    for d, t in ordered(texts):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, hashlib.sha256(kept).hexdigest()] = (len(data), sum(gone), spans)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_substrings_equal_brute_force(make_docs, odd_texts, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(substring_dedup, "HOT_PARTS", 2)
        monkeypatch.setattr(substring_dedup, "MERGE", 600)
        monkeypatch.setattr(substring_dedup, "SHARD", 200)
    base = prose(11, 200)
    pick = random.Random(8)
    near = []
    for i in range(25):
        words = base.split(" ")
        for _ in range(pick.randint(0, 6)):
            words[pick.randrange(len(words))] = pick.choice(["", "xé", "the on", "ha\nha"])
        near.append((200 + i, prose(300 + i, 8) + " ".join(words[pick.randrange(30) :])))
    texts = [x for x in odd_texts if len(x[1] or "") < 10_000] + near + [(400, "ab" * 300), (401, base[:99]), (402, base[:100])]
    rows = substring_dedup.remove_repeats(make_docs(texts, clash=True), part_bytes=3000, buckets=4).collect()
    want = plain_substrings(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert want[r.doc_id, r.kept_sha256] == (r.n_bytes, r.n_removed, r.n_spans)
    assert substring_dedup.remove_repeats(make_docs([])).count() == 0


def test_merged_transforms_are_sorted_and_know_their_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        strings = [np.append(rng.integers(1, 4, rng.integers(1, 25)), 0) for _ in range(rng.integers(1, 14))]
        strings += [s.copy() for s in strings[:2]]
        shards, depth = int(rng.integers(1, 5)), int(rng.integers(1, 9))
        transforms, suffixes = [], []
        for own in (strings[i::shards] for i in range(min(shards, len(strings)))):
            text, lengths = np.concatenate(own).astype(np.uint16), np.array([len(s) for s in own])
            order = bwt.suffix_order(text, lengths)
            ends = np.repeat(np.cumsum(lengths), lengths)
            suffixes += [tuple(text[p : ends[p]]) for p in order]
            transforms.append(bwt.transform(text, lengths, order))
        place, prefix = bwt.merge(transforms, depth)
        merged = [suffixes[p] for p in place]
        assert sorted(place) == list(range(len(suffixes)))
        assert [m[:depth] for m in merged] == sorted(m[:depth] for m in merged)
        for a, b, shared in zip(merged, merged[1:], prefix[1:]):
            common = 0
            while common < min(len(a), len(b), depth) and a[common] == b[common] != 0:
                common += 1
            if common == depth or a[common] or b[common]:
                assert shared == common


def plain_tiles(item, text, least):
    """Greedy string tiling by trying every pair of places."""
    a, b, tiles = [False] * len(item), [False] * len(text), 0
    while True:
        best = least - 1
        found = []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] >= 0 and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best >= least:
                    found.append((i, j))
        if not found:
            return tiles
        for i, j in found:
            if not any(a[i : i + best]) and not any(b[j : j + best]):
                a[i : i + best] = b[j : j + best] = [True] * best
                tiles += best


def test_tiles_cover_as_much_as_plain_greedy_tiling():
    pick = random.Random(2)
    for _ in range(150):
        item = [pick.randrange(4) for _ in range(pick.randint(0, 40))]
        text = [pick.randrange(-1, 4) for _ in range(pick.randint(0, 60))]
        text[3:3] = item[5:20]
        tiles = decontamination.tile(item, text, 4)
        got = sum(n for _, _, n in tiles)
        for start, at, n in tiles:
            assert item[start : start + n] == text[at : at + n] and n >= 4
        # Greedy tilings may differ in the order of equal lengths.
        assert abs(got - plain_tiles(item, text, 4)) <= 8


def test_reordered_passages_are_found_and_clean_documents_stay(spark, make_docs, odd_texts):
    item = prose(500, 40).replace("\n", " ").split()
    other = prose(501, 30)
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, other), (9, None), (10, "too short"), (11, "")], "item_id long, text string")
    leak = (900, prose(502, 50) + " " + " ".join(item[20:]).upper() + "! " + prose(503, 9) + " " + ", ".join(item[:20]))
    part = (901, " ".join(item[:15]) + " " + prose(504, 40))
    exact = (902, other)
    docs = make_docs(odd_texts + [leak, part, exact], clash=True)
    marked = {r.doc_id: [tuple(x)[:1] for x in r.leaks] for r in decontamination.with_leaks(docs, benchmark).collect()}
    assert marked[900] == [(7,)] and marked[901] == [] and marked[902] == [(8,)]
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert kept.count() == len(odd_texts) + 1
    assert decontamination.clean(docs, benchmark.limit(0)).count() == docs.count()
    assert decontamination.clean(make_docs([]), benchmark).count() == 0


def test_a_large_benchmark_is_passed_in_slices(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontamination, "SLICE", 300)
    items = [(i, prose(600 + i, 20)) for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(1, items[3][1] + " " + items[9][1]), (2, prose(700, 60))])
    found = {r.doc_id: sorted(x.item_id for x in r.leaks) for r in decontamination.with_leaks(docs, benchmark).collect()}
    assert found == {1: [3, 9], 2: []}
