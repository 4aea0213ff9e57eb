import random

import numpy as np

import corpus_pipeline
from cases import CLASHING, prose
from usageloom.llm import line_dedup, near_dedup, simhash
from usageloom.llm.components import components
from usageloom.llm.staging import Stage


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """Least doc_id (null first) of each group linked by 5-word Jaccard 0.8, over all pairs."""
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / (len(a | b) or 1) >= 0.8 or not (a or b):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(min(-(1 << 63) if d is None else d for d in docs) for docs in groups.values())


def edited(text, share, seed):
    """A copy with so many words replaced that about that share of its shingles differs."""
    pick = random.Random(seed)
    words = text.split()
    for at in pick.sample(range(2, len(words) - 2), max(1, round(share * len(words) / 5))):
        words[at] = f"changed{seed}x{at}"
    return " ".join(words)


def kept_ids(docs, spark):
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(-(1 << 63) if r.doc_id is None else r.doc_id for r in out.collect())


def test_stage_groups_equal_all_pairs(spark, make_docs, odd_texts, monkeypatch):
    texts = list(odd_texts)
    for n in range(40):
        base = prose(200 + n, 150 + 10 * n)
        texts += [(1000 + 10 * n, base)]
        texts += [(1000 + 10 * n + k, edited(base, 0.02 + 0.005 * (n + 10 * k % 37), 10 * n + k)) for k in range(1, 4)]
    # A chain: neighbours are similar, its ends are not.
    long = prose(7, 900).split()
    texts += [(5000 + k, " ".join(long[20 * k : 20 * k + 300])) for k in range(20)]
    monkeypatch.setattr(near_dedup, "TILE", 4)
    assert kept_ids(make_docs(texts, clash=True), spark) == plain_groups(texts)
    assert set(CLASHING) <= set(corpus_pipeline.drop_near_duplicates(spark, make_docs(texts[:3], clash=True), "").columns)
    assert kept_ids(make_docs([]), spark) == []


def test_stage_finds_copies_that_fingerprints_miss(spark, make_docs):
    base = prose(11, 400)
    copy = edited(base, 0.09, 3)
    a, b = plain_shingles(base), plain_shingles(copy)
    assert 0.8 <= len(a & b) / len(a | b) < 0.95
    from usageloom.llm import simhash

    assert (simhash.fingerprint(base.encode()) ^ simhash.fingerprint(copy.encode())).bit_count() > simhash.RADIUS
    assert kept_ids(make_docs([base, copy, prose(12, 400)]), spark) == [0, 2]


def counted_stars(monkeypatch):
    """Comparisons with hubs: those of the fingerprint groups, then those of the buckets."""
    seen = []
    with_hubs = near_dedup.with_hubs

    def counted(stars, sets, *rest):
        seen.append(stars.count())
        return with_hubs(stars, sets, *rest)

    monkeypatch.setattr(near_dedup, "with_hubs", counted)
    return seen


def distance(a, b):
    prints = [simhash.fingerprint(t.encode(), near_dedup.WORDS) for t in (a, b)]
    return (prints[0] ^ prints[1]).bit_count()


def test_fingerprints_find_copies_without_any_band(spark, make_docs, monkeypatch):
    """The SimHash search links by itself, and what it brings together is verified."""
    by_bands = near_dedup.by_bands
    monkeypatch.setattr(near_dedup, "by_bands", lambda prints: by_bands(prints).limit(0))
    seen = counted_stars(monkeypatch)
    base, other = prose(21, 400), prose(22, 400)
    copies = [base, base + " end", base.replace(" ", "\n", 3) + " fin", other, other + " end"]
    # Repeats make fingerprints equal, though few different shingles are shared.
    block = " ".join([prose(23, 31)] * 200)
    alike = [block + " " + " ".join(f"{w}{i}" for i in range(60)) for w in "xy"]
    assert distance(*alike) <= simhash.RADIUS
    assert all(distance(a, b) <= simhash.RADIUS for a, b in [(copies[0], copies[1]), (copies[0], copies[2]), (copies[3], copies[4])])
    a, b = map(plain_shingles, alike)
    assert len(a & b) < 0.8 * len(a | b)
    texts = list(enumerate([*copies, *alike, prose(24, 200)]))
    assert kept_ids(make_docs(texts), spark) == plain_groups(texts) == [0, 3, 5, 6, 7]
    assert seen == [4, 0]


def test_buckets_that_fingerprints_joined_are_not_compared_again(spark, make_docs, monkeypatch):
    seen = counted_stars(monkeypatch)
    base = prose(25, 600)
    close = [base, *[f"{base} end{i}" for i in range(20)]]
    assert max(distance(base, t) for t in close) <= simhash.RADIUS
    assert kept_ids(make_docs([*close, prose(26, 100)]), spark) == [0, 21]
    assert seen == [20, 0]


def template_texts(n, changed, seed=5):
    """Texts of one template with some words changed in each."""
    pick = random.Random(seed)
    base = prose(seed, 120).split()
    out = []
    for i in range(n):
        words = list(base)
        for at in pick.sample(range(120), changed):
            words[at] = f"w{i}x{at}"
        out.append(" ".join(words))
    return out


def test_template_families_make_no_pair_rows(spark, make_docs, monkeypatch):
    """Rows of a family grow in proportion to it, though all its members share buckets and none links."""
    seen = {}
    within = near_dedup.within_hubs

    def counted(stars, comps):
        links = within(stars, comps)
        seen["stars"], seen["links"] = stars.count(), links.count()
        return links

    monkeypatch.setattr(near_dedup, "within_hubs", counted)
    sizes = {}
    for n in (200, 400, 800):
        roots = near_dedup.near_duplicates(make_docs(template_texts(n, 4))).select("root").distinct().count()
        assert roots == n
        sizes[n] = seen["stars"]
        assert seen["links"] == 0
    assert sizes[800] < 5 * sizes[200] and sizes[800] <= 800 * near_dedup.BANDS


def test_template_family_that_links_in_part(spark, make_docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 16)
    texts = template_texts(90, 4) + template_texts(60, 1) + template_texts(30, 2)
    texts += [edited(t, 0.05, 900 + i) for i, t in enumerate(template_texts(30, 4))]
    docs = [(i, t) for i, t in enumerate(texts)]
    assert kept_ids(make_docs(docs), spark) == plain_groups(docs)


def test_intersections_and_forest_equal_plain_sets():
    pick = random.Random(8)
    hub = sorted(pick.sample(range(10**9), 37))
    sets = [sorted({*pick.sample(hub, pick.randint(0, 37)), *pick.choices(range(60), k=pick.randint(0, 25))}) for _ in range(70)]
    sets.append([])
    arrays = [np.array(s, np.uint64) for s in sets]
    base = np.array(hub, np.uint64)
    has = [np.packbits(np.isin(base, a)).tobytes() for a in arrays]
    besides = [a[~np.isin(a, base)].tobytes() for a in arrays]
    common = near_dedup.intersections(has, besides)
    want = np.array([[len(set(a) & set(b)) for b in sets] for a in sets])
    assert (common == want).all()
    part = near_dedup.intersections(has, besides, 30)
    assert (part == want[:30, 30:]).all()
    nodes = np.arange(len(sets))
    sizes = np.array([len(s) for s in sets])
    links = near_dedup.forest(nodes, sizes, nodes.copy(), common, 0.5)
    assert len(links) < len(nodes) and all(near_dedup.near_enough(want[a][b], sizes[a] + sizes[b] - want[a][b], 0.5) for a, b in links)
    root = list(range(len(sets)))
    for a, b in links:
        old, new = root[b], root[a]
        root = [new if r == old else r for r in root]
    for a in range(len(sets)):
        for b in range(a):
            if near_dedup.near_enough(want[a][b], sizes[a] + sizes[b] - want[a][b], 0.5):
                assert root[a] == root[b]


def broadcasts(spark, run):
    """Broadcast tables in the final plans of the queries that a call runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = store.executionsList(before, store.executionsCount() - before)
    plans = [rows.apply(i).physicalPlanDescription() for i in range(rows.size())]
    assert len(plans) > 10
    return sum(p.split("== Initial Plan ==")[0].split("\n\n")[0].count("BroadcastExchange") for p in plans)


def test_small_joins_stay_off_the_driver(spark, make_docs):
    """Many rounds over small tables: none of them is collected and held by the driver."""
    base = prose(31, 200)
    docs = make_docs([base, edited(base, 0.05, 1), edited(base, 0.1, 2), base + " end", prose(32, 200)])
    found = []
    assert broadcasts(spark, lambda: found.append(near_dedup.near_duplicates(docs))) == 0
    assert found[0].select("root").distinct().count() == 2
    # Line dedup broadcasts one short list of counts per suffix rank, no table of rows.
    lines = make_docs([f"{base}\n{prose(33, 20)}\nown {n}" for n in range(3)])
    assert broadcasts(spark, lambda: line_dedup.without_repeats(lines)) <= 4


def test_known_components_take_one_round(spark):
    stage = Stage(spark, "test")
    path = spark.createDataFrame([(n + 1, n) for n in range(40)], "u long, v long")
    found = stage.keep(components(stage, path))
    assert sorted(map(tuple, found.collect())) == [(n, 0) for n in range(1, 41)]
    kept = len(stage.kept)
    again = components(stage, found.withColumnsRenamed({"node": "u", "root": "v"}))
    assert sorted(map(tuple, again.collect())) == [(n, 0) for n in range(1, 41)]
    assert len(stage.kept) == kept + 3
