"""Operator 11: centroid clustering with Hamerly's bounds.

Vectors are whole numbers, so that sums, centroids and distances are exact. A vector keeps its cluster, one
upper bound of its distance to that centroid and one lower bound of its distance to any other. When centroids
have moved, the upper bound grows by the drift of the own centroid, the lower one shrinks by the largest drift
of the others. While the upper bound is below the lower one, or below half the way from its centroid to the
next, the vector stays where it is, unread; else the upper bound is made exact, and where that isn't enough
all distances are computed in whole numbers. Bounds are rounded outwards, and only a strict "less" decides, so
that ties always come to the full scan, which gives them to the smaller number.

The state (vector, cluster, bounds) is a table in the shared folder, written anew each round. Sums of the
clusters are carried on: only vectors that moved are added to one and taken from another, with partial sums
before the shuffle, so that a cluster of any size is one row per task. What reaches the driver are the
centroids and these sums: ``k`` rows, whatever the table's size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Versions

DIMENSIONS, SCALE = 64, 256
CLUSTERS, ROUNDS, SEED = 40, 5, 2
#: Scaled components beyond this have no distance that a long holds.
LARGEST = 1 << 27
#: Bounds are rounded outwards by more than the error of a root or a sum.
UP, DOWN = 1 + 1e-12, 1 - 1e-12
#: Vectors whose distances to all centroids are computed at once.
SCAN = 4_096

STATE = "vec_id long, x array<int>, was int, cluster int, upper double, lower double, scanned boolean, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def scaled(vectors: DataFrame, vec_id: str, embedding: str, dimensions: int, scale: int) -> DataFrame:
    """(vec_id, x): sound vectors of so many components, as floor(scale * component)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("v", lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits")).cast("int")))
    return rows.filter((F.size("v") == dimensions) & finite).select("vec_id", whole.alias("x"))


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``; equal ids in order of their components, null ids last."""
    first = rows.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "x").orderBy(F.asc_nulls_last("h"), "x").limit(k)
    return np.array([r.x for r in first.collect()], np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all to all."""
    return (x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * (x @ centroids.T)


def own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(1)


def halves(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the next one, rounded down."""
    d = distances(centroids, centroids).astype(float)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(1, initial=np.inf)) / 2 * DOWN


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, upper bound and lower bound of each vector, by all distances."""
    d = distances(x, centroids)
    cluster = d.argmin(1)
    nearest = d[np.arange(len(x)), cluster]
    second = np.partition(d, 1, 1)[:, 1] if len(centroids) > 1 else np.full(len(x), np.inf)
    return cluster, np.sqrt(nearest) * UP, np.sqrt(second) * DOWN


def settle(x, cluster, upper, lower, centroids, drift) -> np.ndarray:
    """Brings clusters and bounds up to date in place; says which vectors had a full scan. ``cluster`` is below 0 where none is known."""
    new = cluster < 0
    if drift is not None:
        at = np.maximum(cluster, 0)
        top = int(drift.argmax())
        others = np.where(at == top, np.delete(drift, top).max(initial=0), drift[top])
        upper[:] = (upper + drift[at]) * UP
        lower[:] = np.maximum(lower - others, 0) * DOWN
        bound = np.maximum(lower, halves(centroids)[at])
        doubtful = np.flatnonzero(~new & (upper >= bound))
        upper[doubtful] = np.sqrt(own_distances(x[doubtful], centroids, cluster[doubtful])) * UP
        todo = new.copy()
        todo[doubtful] = upper[doubtful] >= bound[doubtful]
    else:
        todo = np.ones(len(x), bool)
    rows = np.flatnonzero(todo)
    for k in range(0, len(rows), SCAN):
        part = rows[k : k + SCAN]
        cluster[part], upper[part], lower[part] = scan(x[part], centroids)
    return todo


def assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    """The state after the centroids have come to be ``centroids``; the last one has exact distances."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, drift))
    names = [f.split()[0] for f in STATE.split(", ")]

    def run(batches):
        now, moved = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            x = column["x"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            if moved is None:
                was, upper, lower = np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x))
            else:
                was, upper, lower = (column[c].to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
            cluster = was.astype(np.int64)
            scanned = settle(x, cluster, upper, lower, now, moved)
            distance = pa.array(own_distances(x, now, cluster)) if last else pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([column["vec_id"], column["x"], pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned), distance], names=names)

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, dimensions: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors, sums): what moved vectors add to their clusters and take from those they were in."""
    moved = state.filter("was <> cluster").select(F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("s")), F.struct(F.col("was").alias("c"), F.lit(-1).cast("long").alias("s")))).alias("m"), "x")
    sums = [F.sum(F.col("m.s") * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dimensions)]
    found = moved.filter("m.c >= 0").groupBy("m.c").agg(F.sum("m.s").alias("n"), *sums).collect()
    return [(r[0], r[1], list(r[2:])) for r in found]


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, trace: list | None = None
) -> DataFrame:
    """RESULT for every vector with exactly ``dimensions`` components, none null or non-finite: Lloyd's rounds in whole numbers.

    Vectors that are null, of another length or not finite have no row. Repeated rows of an id are vectors
    of their own, null ids too; these are no seeds while others are left. Fewer vectors than ``k`` give as
    many centroids; an empty table gives an empty one. A component of 2^27 / scale or more is an error.
    Other columns are dropped, whatever their names. ``trace`` gets the number of full scans of each round.
    """
    spark = vectors.sparkSession
    kept = scaled(vectors, vec_id, embedding, dimensions, scale)
    versions = Versions(spark)
    state = versions.write(kept)
    centroids = seeds(state, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    number, sums = [0] * len(centroids), [[0] * dimensions for _ in centroids]
    drift = None
    for n in range(rounds + 1):
        state = versions.write(assigned(state, centroids, drift, n == rounds))
        if trace is not None:
            trace.append(state.filter("scanned").count())
        if n == rounds:
            break
        for c, count, added in changes(state, dimensions):
            number[c] += count
            sums[c] = [a + b for a, b in zip(sums[c], added, strict=True)]
        new = np.array([[s // m for s in total] if m else old.tolist() for total, m, old in zip(sums, number, centroids, strict=True)], np.int64)
        drift, centroids = np.sqrt(own_distances(new, centroids, np.arange(len(new)))) * UP, new
    spread = {r[0]: r[1] for r in state.groupBy("cluster").agg(F.sum("distance")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = spark.createDataFrame([(c, total, sum(spread.values()), digests[c]) for c, total in spread.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir):
    """All vectors of 64 components in forty clusters, after five rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
