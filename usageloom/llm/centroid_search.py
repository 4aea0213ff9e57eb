"""Exact k-means in integers by equal-average equal-variance search.

Components become whole numbers, so distances and means have no rounding. For
the nearest centroid of a vector, centroids are visited outward from the
vector's mean. With S the sum, V the root of the squared deviation sum and k the
number of components, every centroid obeys

    distance >= (S - S')^2 / k                       (equal average)
    distance >= (S - S')^2 / k + (V - V')^2          (equal variance)

The first bound grows along the scan, so a vector is finished once it exceeds
the best distance so far; the second rejects single centroids. Only those left
are compared component by component, in integers. Both bounds are used with
slack for the floating-point root; equal distances go to the smaller number.

A round is one pass: tasks add up their vectors per centroid, and the driver
receives the totals of at most ``K`` centroids, whatever the size of the table.

Defined cases: a vector that is null, has another number of components, or a
null or non-finite one is left out; so is one with a component of 2^19 or more
in size, whose squared distance a long may not hold. A null vec_id counts as an
empty number in the draw of the first centroids. Rows of one vec_id that differ
are drawn in the order of their components. Fewer vectors than centroids give so
many centroids; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import column
from usageloom.llm.staging import Stage

K = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
#: Components below this size keep a squared distance below 2^62.
LARGEST = 1 << 27
_ROWS = 4096


def kept_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and the whole components v of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double") * SCALE)
    # A comparison with NaN or null is never true inside the bounds.
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (c >= -LARGEST) & (c < LARGEST))
    sized = vectors.where(F.size("embedding") == components).where(good)
    return sized.select("vec_id", F.transform(x, lambda c: F.floor(c).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int = K) -> np.ndarray:
    """The k vectors of the smallest hashes; k rows reach the driver."""
    draw = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(draw.alias("draw"), "v").orderBy("draw", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


class Codebook:
    """Centroids sorted by mean, searched for a block of vectors at a time."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.rows = centroids[self.order]
        self.sums = sums[self.order].astype(np.float64)
        self.spread = _spread(self.rows)
        self.compared = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance, both exact."""
        n, (k, width) = len(vectors), self.rows.shape
        sums, spread = vectors.sum(axis=1).astype(np.float64), _spread(vectors)
        # Two ends move outward from where the vector's mean would stand.
        high = np.searchsorted(self.sums, sums)
        low = high - 1
        best = np.full(n, np.iinfo(np.int64).max)
        found = np.full(n, k)
        alive = np.arange(n)
        for _ in range(k):
            lo, hi = low[alive], high[alive]
            down = np.where(lo >= 0, sums[alive] - self.sums[np.maximum(lo, 0)], np.inf)
            up = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - sums[alive], np.inf)
            left = down <= up
            at = np.where(left, lo, hi)
            average = np.minimum(down, up) ** 2 / width
            limit = best[alive].astype(np.float64) * (1 + 1e-9) + 1
            near = average <= limit
            alive, at, left, average, limit = alive[near], at[near], left[near], average[near], limit[near]
            if not len(alive):
                break
            low[alive] -= left
            high[alive] += ~left
            close = average + (spread[alive] - self.spread[at]) ** 2 <= limit
            rows, at = alive[close], at[close]
            step = vectors[rows] - self.rows[at]
            distance = np.einsum("ij,ij->i", step, step)
            number = self.order[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < found[rows]))
            best[rows[better]] = distance[better]
            found[rows[better]] = number[better]
            self.compared += len(rows)
        return found, best


def _spread(vectors: np.ndarray) -> np.ndarray:
    """Root of the sum of squared deviations from the own mean."""
    own = vectors.astype(np.float64)
    own -= own.mean(axis=1, keepdims=True)
    return np.sqrt(np.einsum("ij,ij->i", own, own))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            part = batch.slice(first, _ROWS)
            yield part, column(part, "v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, -1)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; without vectors as before."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, vectors in _blocks(batches):
            own, _ = book.nearest(vectors)
            counts += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            present, starts = np.unique(own[order], return_index=True)
            sums[present] += np.add.reduceat(vectors[order], starts)
        some = np.flatnonzero(counts)
        arrays = [pa.array(some, pa.int32()), pa.array(counts[some])]
        names = ["cluster", "n", *[f"s{i}" for i in range(width)]]
        yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(sums[some, i]) for i in range(width)]], names)

    columns = [f"s{i}" for i in range(width)]
    schema = "cluster int, n long, " + ", ".join(f"{c} long" for c in columns)
    totals = kept.select("v").mapInArrow(run, schema).groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in columns]
    )
    out = centroids.copy()
    for row in totals.collect():
        out[row.cluster] = [int(row[c]) // row.n for c in columns]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(centroids)
        for part, vectors in _blocks(batches):
            own, distance = book.nearest(vectors)
            yield pa.RecordBatch.from_arrays(
                [column(part, "vec_id"), pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, components: int = COMPONENTS) -> DataFrame:
    """Every vector's cluster and distance, with the sums of its cluster and of all, and its centroid's hash."""
    spark = vectors.sparkSession
    stage = Stage(spark, "centroids")
    kept = stage.keep(kept_vectors(vectors, components))
    centroids = first_centroids(kept, k)
    facts = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return assigned_nothing(kept, facts)
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    rows = stage.keep(assigned(kept, centroids))
    per = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(c, s, sum(per.values()), digests[c]) for c, s in per.items()]
    # One row per centroid, k at most.
    out = rows.join(F.broadcast(spark.createDataFrame(known, facts)), "cluster")
    stage.leave(rows)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def assigned_nothing(kept: DataFrame, facts: str) -> DataFrame:
    """No rows, in the columns of a result."""
    none = kept.sparkSession.createDataFrame([], facts).withColumn("vec_id", F.lit(None).cast(kept.schema["vec_id"].dataType))
    return none.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
