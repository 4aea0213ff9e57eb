import re

import numpy as np
import pytest
import xxhash

from cases import CLASHING, prose
from usageloom.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints):
    """Least doc_id reachable over links of 4 bits or fewer."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(doc)
    return [min((d for d in groups[find(i)] if d is not None), default=None) for i in range(len(prints))]


def test_components_equal_brute_force(make_docs, odd_texts):
    base = prose(5, 400).split()
    near = [" ".join(base[: 380 + i]) for i in range(12)]
    texts = odd_texts + [(100 + i, t) for i, t in enumerate(near)]
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(make_docs(texts)).collect()), key=str)
    prints = [(d, plain_fingerprint(t)) for d, t in texts]
    want = sorted(((d if d is not None else -1, f, c) for (d, f), c in zip(prints, plain_components(prints))), key=str)
    assert rows == want


def test_one_document_of_each_group_stays(make_docs, odd_texts):
    docs = make_docs(odd_texts, clash=True)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicates(docs).select("root").distinct().count()
    assert kept.count() == groups
    assert simhash.one_of_each(make_docs([])).count() == 0
    assert set(CLASHING) <= set(kept.columns)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 6])
@pytest.mark.parametrize("split", [False, True])
def test_bit_sliced_blocks_find_every_link(radius, split):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    for i in range(120):
        flips = rng.choice(64, rng.integers(0, 8), replace=False)
        fps[150 + i] = fps[rng.integers(0, 150)] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0))
    group = np.sort(rng.integers(0, 3, 300))
    side = rng.integers(0, 2, 300) if split else np.zeros(300, int)
    u, v = simhash.block_links(group, side, fps, radius)
    linked = {}

    def find(links, x):
        while links.get(x, x) != x:
            x = links[x]
        return x

    for a, b in zip(u.astype(np.uint64).tolist(), v.astype(np.uint64).tolist()):
        linked[find(linked, a)] = find(linked, b)
    want = {}
    for i in range(300):
        for j in range(i):
            if group[i] == group[j] and (side[i] != side[j] or not split):
                if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius:
                    want[find(want, int(fps[i]))] = find(want, int(fps[j]))
    for i in range(300):
        for j in range(i):
            a, b = int(fps[i]), int(fps[j])
            assert (find(linked, a) == find(linked, b)) == (find(want, a) == find(want, b))


def test_a_tiled_bucket_loses_no_link(spark, make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    texts = [prose(7, 300 - i) for i in range(30)] + [prose(50 + i, 40) for i in range(20)]
    out = {r.doc_id: r.component_id for r in simhash.near_duplicates(make_docs(texts)).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in enumerate(texts)]
    assert [out[i] for i in range(len(texts))] == plain_components(prints)
