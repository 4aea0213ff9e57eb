import hashlib
import math
import random

import numpy as np

from usageloom.llm import centroid_search


def plain_clusters(rows, k, rounds, width):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid hash), with whole numbers and full search."""
    kept = [
        (i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)
    ]
    drawn = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    own = {}
    for _, d, n in found:
        own[n] = own.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if i is None else i, n, d, own[n], sum(own.values()), digest[n]) for i, d, n in found)


def vectors(seed, n, width):
    pick = random.Random(seed)
    centers = [[pick.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [float(np.float32(c + pick.gauss(0, 0.3))) for c in centers[i % 6]]) for i in range(n)]


def clustered(spark, rows, k, rounds, width):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, v int")
    out = centroid_search.cluster(table, k, rounds, width)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in out.collect())


def test_equals_full_search_in_whole_numbers(spark):
    rows = vectors(1, 400, 8)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one very common vector
    rows += [(1, rows[2][1]), (1, rows[1][1]), (None, rows[5][1]), (2000, None), (2001, []), (2002, [0.0] * 7)]
    rows += [(2003, [0.0] * 7 + [None]), (2004, [0.0] * 7 + [math.nan]), (2005, [math.inf] + [0.0] * 7), (2006, [1e30] + [0.0] * 7)]
    rows += [(2007, [-0.0] * 8), (2008, [2.0**18] * 8), (2009, [-(2.0**18)] * 8)]
    assert clustered(spark, rows, 12, 5, 8) == plain_clusters(rows, 12, 5, 8)


def test_production_shape(spark):
    rows = vectors(2, 150, 64)
    assert clustered(spark, rows, 40, 5, 64) == plain_clusters(rows, 40, 5, 64)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = vectors(3, 5, 8)
    assert clustered(spark, rows, 40, 5, 8) == plain_clusters(rows, 40, 5, 8)
    assert clustered(spark, [], 40, 5, 8) == []


def test_ties_go_to_the_smaller_number():
    book = centroid_search.Codebook(np.array([[4, 0], [0, 4], [4, 0], [-4, 0]], np.int64))
    found, distance = book.nearest(np.array([[2, 2], [4, 0], [0, 0], [-4, 1]], np.int64))
    assert found.tolist() == [0, 0, 0, 3] and distance.tolist() == [8, 0, 16, 1]


def test_inequalities_reject_most_centroids():
    pick = np.random.default_rng(4)
    centroids = pick.integers(-80, 80, (40, 64)) + pick.integers(-300, 300, (40, 1))
    rows = centroids[pick.integers(0, 40, 2000)] + pick.integers(-9, 9, (2000, 64))
    book = centroid_search.Codebook(centroids)
    found, distance = book.nearest(rows)
    full = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (found == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert book.compared < 0.2 * full.size
