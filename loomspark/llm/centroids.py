"""Centroid clustering with Elkan's bounds.

Every vector keeps, from round to round, an upper bound of the distance to its centroid and a lower bound for each centroid.
Centroids move by a known distance, which loosens the bounds by as much; a centroid whose lower bound, or half of whose
distance to the own centroid, is above the upper bound can't be nearer and isn't looked at.  Bounds are rounded to the safe
side and a centroid is skipped only where it is strictly farther, so equal distances are always met and go to the smaller
number.  Distances that are looked at are sums of whole numbers.  A round is one pass over the table of vectors and bounds,
which is written anew; what comes to the driver are the sums of each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import drop_stored, store


@dataclass(frozen=True)
class Parameters:
    centroids: int = 16
    rounds: int = 3
    components: int = 64
    #: A component counts as floor(scale * x).
    scale: int = 64
    seed: int = 1
    #: Components that are larger as whole numbers count as not finite: their squares would not add up in 64 bits.
    largest: int = 2**26


#: Factors that move a bound to the safe side by more than the operations before it can be off.
UP, DOWN = 1 + 2.0**-49, 1 - 2.0**-49


def upper(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * UP


def lower(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * DOWN


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one centroid."""
    d = x.astype(np.int64) - c
    return (d * d).sum(axis=1)


@dataclass(frozen=True)
class Round:
    """What a pass knows: the centroids, and how far each has moved at most since the last pass (None: no bounds yet)."""

    centroids: np.ndarray
    moved: np.ndarray | None
    #: Whether the exact distance to the own centroid is wanted of every vector.
    last: bool = False

    def between(self) -> np.ndarray:
        """Half distances of the centroids, rounded down."""
        c = self.centroids
        return np.stack([lower(squared(c, x)) for x in c]) * 0.5


def assigned(x: np.ndarray, own: np.ndarray, far: np.ndarray, low: np.ndarray, r: Round) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(centroid, upper bound, lower bounds, exact squared distance where it was asked or else -1, distances computed) of x."""
    k, n = len(r.centroids), len(x)
    if r.moved is None:
        every = np.stack([squared(x, c) for c in r.centroids], axis=1)
        own = every.argmin(axis=1)
        best = every[np.arange(n), own]
        return own, upper(best), lower(every), best, n * k
    low = np.maximum(low - r.moved, 0.0) * DOWN
    half = r.between()
    np.fill_diagonal(half, np.inf)
    far = (far + r.moved[own]) * UP
    best = np.full(n, -1, np.int64)
    near = half[own].min(axis=1) <= far
    near &= ((low <= far[:, None]) & (np.arange(k) != own[:, None])).any(axis=1)
    for j in range(k):
        at = np.flatnonzero((own == j) & (near | r.last))
        best[at] = squared(x[at], r.centroids[j])
        far[at], low[at, j] = upper(best[at]), lower(best[at])
    open_, looked = np.flatnonzero(near), int((best >= 0).sum())
    for j in range(k):
        at = open_[(own[open_] != j) & (low[open_, j] <= far[open_]) & (half[own[open_], j] <= far[open_])]
        if not len(at):
            continue
        looked += len(at)
        d = squared(x[at], r.centroids[j])
        low[at, j] = lower(d)
        nearer = (d < best[at]) | ((d == best[at]) & (j < own[at]))
        at, d = at[nearer], d[nearer]
        own[at], best[at], far[at] = j, d, upper(d)
    return own, far, low, best, looked


def _lists(col: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists alike long, as a table."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _list_column(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), pa.int32()), pa.array(a.ravel(), kind))


def one_pass(batches: Iterator[pa.RecordBatch], r: Round) -> Iterator[pa.RecordBatch]:
    """Rows with new centroids and bounds; then, of each centroid, count, sum of distances and sums of components of the task."""
    k, width = r.centroids.shape
    count, inertia, sums, looked = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0
    key = None
    for b in batches:
        key = b.column("vec_id").type
        if not len(b):
            continue
        x = _lists(b.column("v")).astype(np.int32)
        given = r.moved is not None
        own = b.column("cluster").to_numpy().astype(np.int64) if given else np.zeros(0, np.int64)
        far = b.column("far").to_numpy().copy() if given else np.zeros(0)
        low = _lists(b.column("low")) if given else np.zeros((0, k))
        own, far, low, best, n = assigned(x, own, far, low, r)
        looked += n
        count += np.bincount(own, minlength=k)
        np.add.at(inertia, own, best)
        np.add.at(sums, own, x.astype(np.int64))
        rows = pa.nulls(len(b), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id"), _list_column(x, pa.int32()), pa.array(own.astype(np.int32)), pa.array(far), _list_column(low, pa.float64()), pa.array(best), rows, rows, pa.nulls(len(b), pa.list_(pa.int64()))],
            names=["vec_id", "v", "cluster", "far", "low", "distance", "count", "looked", "sums"],
        )
    if key is not None:
        none = lambda t: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays(
            [none(key), none(pa.list_(pa.int32())), pa.array(np.arange(k, dtype=np.int32)), none(pa.float64()), none(pa.list_(pa.float64())), pa.array(inertia), pa.array(count), pa.array([looked] + [0] * (k - 1)), _list_column(sums, pa.int64())],
            names=["vec_id", "v", "cluster", "far", "low", "distance", "count", "looked", "sums"],
        )


def usable(vectors: DataFrame, embedding: str, vec_id: str, p: Parameters) -> DataFrame:
    """(vec_id, v): the vectors that have the right number of components, all finite, as whole numbers."""
    whole = F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * p.scale))
    fine = F.forall(F.col(embedding), lambda x: x.isNotNull() & (F.abs(x.cast("double") * p.scale) < p.largest))
    rows = vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) == p.components)).filter(F.coalesce(fine, F.lit(False)))
    return rows.select(F.col(vec_id).alias("vec_id"), F.transform(whole, lambda x: x.cast("int")).alias("v"))


def centroid_clusters(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", p: Parameters = Parameters()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that can be used.

    Vectors that are null, have another number of components, or hold a null, non-finite or enormous one are left out.
    Centroids start as the vectors with the smallest hash of seed and vec_id; of rows with one vec_id the smallest vector comes
    first, rows without a vec_id start none.  With fewer vectors than centroids there are as many centroids as vectors, with
    none the result is empty.  Repeated rows are vectors of their own; equal distances go to the smaller number; a centroid
    without vectors stays where it is.  Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = store(usable(vectors, embedding, vec_id, p), "vectors")
    key = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.filter("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(p.centroids).collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, v array<int>, cluster int, far double, low array<double>, distance long, count long, looked long, sums array<long>"
    if not first:
        out = "vec_id, cast(0 as int) cluster, 0L distance, 0L cluster_inertia, 0L inertia, '' centroid_sha256"
        return rows.filter(F.lit(False)).selectExpr(*out.split(", "))
    now, moved, state = np.array([r.v for r in first], np.int64), None, rows
    for step in range(p.rounds + 1):
        r = Round(now, moved, step == p.rounds)
        # The loop's variable is bound here: the pass runs when it is stored, in this turn.
        new = store(state.mapInArrow(lambda batches, r=r: one_pass(batches, r), schema), "bounds")
        drop_stored(spark, state)
        state = new.filter("count is null").drop("count", "looked", "sums")
        totals = new.filter("count is not null")
        if step < p.rounds:
            now, moved = _next(totals, now)
    spent = totals.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    spent = spent.withColumn("inertia", F.lit(spent.agg(F.sum("cluster_inertia")).first()[0]).cast("long"))
    names = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(now.tolist())]
    # A row a centroid, so both fit everywhere.
    facts = spent.join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    out = store(state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    drop_stored(spark, new)
    return out


def _next(totals: DataFrame, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The means of the vectors of each centroid, rounded down, and how far each centroid is moved, rounded up."""
    parts = totals.select("cluster", "count", F.posexplode("sums").alias("i", "s"))
    found = parts.groupBy("cluster", "i").agg(F.sum("s").alias("s"), F.sum("count").alias("n")).filter("n > 0").collect()
    then = now.copy()
    for r in found:
        then[r.cluster, r.i] = r.s // r.n
    d = then - now
    return then, upper((d * d).sum(axis=1))
