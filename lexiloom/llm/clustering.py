"""Exact k-means on whole numbers, with heap-ordered bounds.

An assignment leaves each vector with a gap: the distance to the second nearest centroid less that to its
own. The gap cannot close before the centroids have moved as far, so each cluster keeps its vectors in a
heap ordered by gap plus the drift the cluster had gathered when the vector came in. After a move only
the vectors at the top, whose key the gathered drift has reached, are popped and compared with all
centroids again; the rest keep their cluster unseen.

The heaps live in written tables. Every assignment adds a generation, sorted by cluster and key: a sorted
run is a heap whose pops are a slice, found by a pushed filter on cluster and key. Since gathered drift
only grows, a vector of an older generation is still in its heap exactly if its key lies above the drift, so
nothing is rewritten. Sums per centroid change by the vectors that changed cluster. What reaches the
driver is the centroids and one sum per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..storage import drop_table, write_table

#: Components are held within this bound on either side, so that any distance fits a long.
MOST = 1 << 27
#: Bounds in floating point give way by this share, so that rounding never hides a change of cluster.
_SLACK = 1e-12
_LONG = (1 << 63) - 1
_FEW = 64


@dataclass
class _Heaps:
    """Generations of (id, v, old, cluster, key), and the drift each cluster has gathered."""

    generations: list[DataFrame]
    paths: list[str]
    drift: np.ndarray

    def held(self, g: int) -> Column:
        """Whether a row of a generation still is in its heap; in the last one all are."""
        if g == len(self.generations) - 1:
            return F.lit(True)
        return _by_cluster(self.drift, lambda key, d: key > d)

    def popped(self, drift: np.ndarray) -> DataFrame:
        """Rows whose keys are reached as the drift grows to ``drift``."""
        parts = [table.where(self.held(g)).where(_by_cluster(drift, lambda key, d: key <= d))
                 for g, table in enumerate(self.generations)]
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def all(self) -> DataFrame:
        out = self.generations[-1]
        for g, table in enumerate(self.generations[:-1]):
            out = out.union(table.where(self.held(g)))
        return out


def _by_cluster(drift: np.ndarray, test) -> Column:
    """A filter the scan can use: one range of keys per cluster, unless there are very many."""
    if len(drift) > _FEW:
        return test(F.col("key"), F.get(F.array(*[F.lit(float(d)) for d in drift]), F.col("cluster")))
    out = F.lit(False)
    for j, d in enumerate(drift):
        out = out | ((F.col("cluster") == j) & test(F.col("key"), F.lit(float(d))))
    return out


def whole_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """``id, v``: vectors of ``dims`` finite components, each as floor(scale * component)."""
    x = F.col(vector).cast("array<double>")
    good = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(MOST))), F.lit(-float(MOST))))
                        .cast("int"))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(key).alias("id"), whole.alias("v"))


def _first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose seeded id hashes lowest; rows without an id come last."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), dims)


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _assigned(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """``rows`` (id, v, cluster) compared with all centroids: the generation they form."""
    dims = centroids.shape[1]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = _distances(_matrix(batch["v"], dims), centroids)
            nearest = d.argmin(axis=1)  # the smaller number among equals
            upper = np.sqrt(d[np.arange(len(d)), nearest].astype(np.float64))
            d[np.arange(len(d)), nearest] = _LONG
            lower = np.sqrt(d.min(axis=1).astype(np.float64)) if len(centroids) > 1 else np.full(len(d), np.inf)
            gap = lower * (1 - _SLACK) - upper * (1 + _SLACK)
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "old": batch["cluster"],
                                "cluster": nearest.astype(np.int32), "key": gap + drift[nearest]})

    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.IntegerType())),
                           T.StructField("old", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
                           T.StructField("key", T.DoubleType())])
    return rows.select("id", "v", "cluster").mapInPandas(scan, schema).sortWithinPartitions("cluster", "key")


def _change(generation: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed cluster add to every cluster's sums and count.

    Each task sums its rows first, so at most ``k`` rows a task are exchanged.
    """

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v = _matrix(batch["v"], dims)
            for column, sign in (("cluster", 1), ("old", -1)):
                at = batch[column].to_numpy()
                for j in np.unique(at[at >= 0]):
                    sums[j] += sign * v[at == j].sum(axis=0)
                    counts[j] += sign * int((at == j).sum())
        for j in np.flatnonzero((sums != 0).any(axis=1) | (counts != 0)):
            yield pd.DataFrame({"cluster": [j], "part": [[counts[j], *sums[j]]]})

    moved = generation.where("old != cluster").select("v", "old", "cluster")
    parts = moved.mapInPandas(add, "cluster int, part array<bigint>")
    totals = parts.select("cluster", F.posexplode("part").alias("i", "x")).groupBy("cluster", "i").agg(
        F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    sums, counts = np.zeros((k, dims), object), np.zeros(k, object)
    for r in totals:
        if r.i:
            sums[r.cluster, r.i - 1] = int(r.x)
        else:
            counts[r.cluster] = int(r.x)
    return sums, counts


def _fit(vectors: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[_Heaps, np.ndarray]:
    k, dims = centroids.shape
    heaps = _Heaps([], [], np.zeros(k))
    sums, counts = np.zeros((k, dims), object), np.zeros(k, object)
    rows = vectors.withColumn("cluster", F.lit(-1))
    for i in range(rounds + 1):
        generation, path = write_table(_assigned(rows, centroids, heaps.drift), f"heap-{i}")
        heaps.generations.append(generation)
        heaps.paths.append(path)
        if i == rounds:
            break
        more, many = _change(generation, k, dims)
        sums, counts = sums + more, counts + many
        moved = np.array([[int(x) // int(n) for x in s] if n else c for s, n, c in zip(sums, counts, centroids)],
                         np.int64)
        steps = np.sqrt(((moved - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + _SLACK)
        others = np.array([np.delete(steps, j).max(initial=0.0) for j in range(k)])
        drift = heaps.drift + (steps + others) * (1 + _SLACK)
        rows, heaps.drift, centroids = heaps.popped(drift), drift, moved
    return heaps, centroids


def cluster_vectors(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1,
                    key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``<key>, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Vectors of another length, null ones, and those with a null or non-finite component are left out.
    Components become floor(scale * x), held within 2^27 on either side. The first centroids are
    the ``k`` vectors whose ``<seed>:<id>`` has the smallest SHA-256 (fewer vectors make fewer clusters; ids that
    are null come last). Every round assigns all vectors (of equally near centroids to the smaller number) and
    moves the centroids to the floored means; an empty one stays. Repeated rows count as often as they come.
    Other columns are not looked at; no usable vectors give no rows.
    """
    vectors = whole_vectors(df, key, vector, dims, scale)
    first = _first_centroids(vectors, k, seed)
    if not len(first):
        return vectors.select(
            F.col("id").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in (
                "distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    heaps, centroids = _fit(vectors, first, rounds)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["v"], dims)
            own = centroids[batch["cluster"].to_numpy()]
            yield pd.DataFrame({"id": batch["id"], "cluster": batch["cluster"],
                                "distance": ((v - own) ** 2).sum(axis=1)})

    kind = vectors.schema["id"].dataType.simpleString()
    measured, _ = write_table(heaps.all().select("id", "v", "cluster").mapInPandas(
        measure, f"id {kind}, cluster int, distance bigint"), "heap-distances")
    for path in heaps.paths:
        drop_table(df.sparkSession, path)
    per_cluster = measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = min(sum(int(r.s) for r in per_cluster), _LONG)
    sums = {r.cluster: min(int(r.s), _LONG) for r in per_cluster}
    table = F.array(*[F.struct(F.lit(sums.get(j, 0)).cast("bigint").alias("s"), F.lit(n).alias("n"))
                      for j, n in enumerate(names)])
    of_cluster = F.get(table, F.col("cluster"))
    return measured.select(
        F.col("id").alias(key), "cluster", "distance", of_cluster["s"].alias("cluster_inertia"),
        F.lit(total).cast("bigint").alias("inertia"), of_cluster["n"].alias("centroid_sha256"))
