"""Centroid clustering by the threshold algorithm.

Each dimension has the list of centroids sorted by their value there. From a vector's value both ends of every list are walked outward;
each centroid met for the first time gets its exact distance. A centroid that no list has shown yet lies, in every dimension, at least as
far off as the next unread entry, so once the sum of these squared frontier distances strictly exceeds the best exact distance
nothing unread can win or tie, and the vector stops. Equal distances go to the smaller centroid number.

Vectors are turned into whole numbers once and written; each round is one pass over them in tasks (`mapInArrow`), which leaves one partial
sum per task and cluster. Sums, counts and means are whole numbers, so neither the partitioning nor a retry changes a result. What is
sent to tasks and what comes back is `k` x `dims` numbers, at most `MOST` (checked).

Vectors that are null, of another length or with null or non-finite components are left out. Repeated rows count each time and
get a row each; rows of one id and vector that are both starts make equal centroids, of which the later stays empty and in place. With fewer
vectors than `k` there are fewer centroids; an empty table gives an empty result. A null id is never a start before other ids. Scaled
components beyond +-2^27 are an error that says so: their squared distance does not fit a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import mapped, written

MOST = 4_000_000      # numbers of all centroids together
LARGEST = 1 << 27     # of a scaled component; 64 squares of twice that fit a long
CELLS = 1 << 18       # cells of the arrays of one step
FAR = np.int64(1) << 40


class Lists:
    """Centroids, and for each dimension their values in rising order with their numbers."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance, for each vector."""
        step = max(1, CELLS // max(vectors.shape[1], len(self.centroids)))
        parts = [self._walk(vectors[at:at + step]) for at in range(0, len(vectors), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _gaps(self, x, low, high):
        """Distance of the next unread entry below and above, FAR where a list has none."""
        k, dims = len(self.centroids), np.arange(x.shape[1])
        below = np.where(low >= 0, x - self.values[dims, np.maximum(low, 0)], FAR)
        return below, np.where(high < k, self.values[dims, np.minimum(high, k - 1)] - x, FAR)

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, dims = len(x), len(self.centroids), np.arange(x.shape[1])
        number, best = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        high = np.stack([np.searchsorted(self.values[d], x[:, d]) for d in dims], axis=1)
        low, seen, alive = high - 1, np.zeros((n, k), bool), np.arange(n)
        below, above = self._gaps(x, low, high)
        while len(alive):
            down = below <= above
            met = self.order[dims, np.where(down, np.maximum(low, 0), np.minimum(high, k - 1))]
            new = np.zeros((len(alive), k), bool)
            new[np.arange(len(alive))[:, None], met] = True
            new &= ~seen
            seen |= new
            row, c = np.nonzero(new)
            exact = np.full((len(alive), k), np.iinfo(np.int64).max)
            exact[row, c] = ((x[row] - self.centroids[c]) ** 2).sum(axis=1)
            c = exact.argmin(axis=1)  # of equal ones the first
            d = exact[np.arange(len(alive)), c]
            better = (d < best[alive]) | ((d == best[alive]) & (c < number[alive]))
            number[alive[better]], best[alive[better]] = c[better], d[better]
            low, high = low - down, high + ~down
            below, above = self._gaps(x, low, high)
            frontier = np.minimum(below, above)
            go = ~seen.all(axis=1) & ~((frontier ** 2).sum(axis=1) > best[alive])
            alive, x, low, high, seen, below, above = (v[go] for v in (alive, x, low, high, seen, below, above))
        return number, best


def _matrix(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    if len(x) and (x.max() > LARGEST or x.min() < -LARGEST):
        raise ValueError(f"a scaled component lies beyond +-{LARGEST}: squared distances would not fit a long")
    return x


def scaled(df: DataFrame, dims: int, scale: int, id: str, vector: str) -> DataFrame:
    """(id, vector) of the kept vectors, components as whole numbers."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return df.where((F.size(x) == dims) & finite).select(
        F.col(id).alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vector"))


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The `k` vectors of smallest hash, in its order; equal hashes by vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.orderBy(h.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.array([r[0] for r in rows], np.int64)


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round."""
    k, dims = centroids.shape
    lists = Lists(centroids)

    def partial(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = _matrix(batch, "vector", dims)
            number, _ = lists.nearest(x) if len(x) else (np.empty(0, np.int64), None)
            count += np.bincount(number, minlength=k)
            by = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.diff(number[by], prepend=-1))
            if len(first):
                total[number[by][first]] += np.add.reduceat(x[by], first, axis=0)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some], pa.int64()),
                                          "total": pa.array(list(total[some]), pa.list_(pa.int64()))})

    sums = (mapped(vectors.select("vector"), partial, "cluster int, n long, total array<long>")
            .select("cluster", "n", F.posexplode("total").alias("d", "part"))
            .groupBy("cluster", "d").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")))
    out = centroids.copy()
    for r in sums.collect():  # k x dims rows
        out[r["cluster"], r["d"]] = int(r["total"]) // r["n"]
    return out


def clustered(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, id: str = "vec_id",
              vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector after `rounds` rounds and a last assignment, and the final centroids."""
    if k * dims > MOST:
        raise ValueError(f"{k} centroids of {dims} numbers are more than {MOST} numbers")
    spark = df.sparkSession
    vectors = written(scaled(df, dims, scale, id, vector), "vectors")
    centroids = starts(vectors, k, seed)
    schema = f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = _means(vectors, centroids)
    lists = Lists(centroids)

    def assigned(batches):
        for batch in batches:
            x = _matrix(batch, "vector", dims)
            if len(x):
                number, distance = lists.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)],
                                                 names=["id", "cluster", "distance"])

    return written(mapped(vectors.select("id", "vector"), assigned, schema), "assigned"), centroids


def digest(df: DataFrame, **how) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, inertia of its cluster and of all, hash of its final centroid."""
    rows, centroids = clustered(df, **how)
    spark = df.sparkSession
    hashes = spark.createDataFrame([(c, hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest()) for c, v in enumerate(centroids)],
                                   "cluster int, centroid_sha256 string")
    each = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    facts = each.crossJoin(each.agg(F.sum("cluster_inertia").alias("inertia"))).join(hashes, "cluster")  # k rows
    return rows.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia",
                                                           "centroid_sha256")
