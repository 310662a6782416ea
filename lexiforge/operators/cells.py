"""Exact dense search in cells: vectors lie by their nearest centroid, queries skip the cells that can't hold an answer.

Centroids come of a bounded sample; every vector goes to its cell, in one shuffle that is linear in the vectors,
and a cell knows its radius, the largest distance of its vectors from the centroid. By the triangle inequality
a unit vector of the cell is no nearer to a query than the query's distance from the centroid less the radius,
which bounds its cosine. A query first looks into the cells next to it; its k-th best cosine there is a
threshold. Then it looks into every other cell whose bound reaches that threshold. Where the bound says little,
as for vectors without clusters, that is every cell: the answer is exact in either case.

Queries are a stated set; they are broadcast in rounds of bounded size and never copied to cells. A filter on
the vectors is applied before they are laid in cells. Only rows that reach the threshold leave a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import built
from .retrieval import top

#: Vectors of which centroids are fitted, by a hash of the id; cells, at most; rounds of the fit.
SAMPLE, CELLS, FIT = 8_192, 512, 8
#: Vectors of a cell, on average, if there aren't more than CELLS times as many.
MEMBERS = 64
#: Cells that a query looks into first.
NEXT = 4
#: Queries that are broadcast at once.
ROUND = 32_768
#: What rounding and sums in doubles may differ by.
SLACK = 1e-5


def sound(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): unit vectors of those that are neither null nor zero and have finite components."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("length", length).filter((F.col("length") > 0) & (F.col("length") < float("inf")))
    return rows.select("id", F.transform("v", lambda x: x / F.col("length")).alias("v"))


def matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def fitted(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of a sample."""
    centroids = x[np.random.default_rng(5).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(FIT):
        at = distances(x, centroids).argmin(1)
        sums, n = np.zeros_like(centroids), np.bincount(at, minlength=len(centroids))
        np.add.at(sums, at, x)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


@dataclass
class Cells:
    centroids: np.ndarray
    #: the largest distance of a cell's vectors from its centroid
    radius: np.ndarray
    #: (cell, id, v), each cell's rows together in a part
    members: DataFrame


def laid(vectors: DataFrame) -> Cells | None:
    """Cells of sound (id, v) of one dimension, or None where there are none."""
    spark = vectors.sparkSession
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("v").combine_chunks()
    if not len(first):
        return None
    x = matrix(first, len(first))
    n = vectors.count() if len(x) == SAMPLE else len(x)
    shared = spark.sparkContext.broadcast(fitted(x, int(min(CELLS, max(1, n // MEMBERS)))))

    @F.arrow_udf("struct<cell: int, away: double>")
    def place(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.struct([("cell", pa.int32()), ("away", pa.float64())]))
        d = distances(matrix(v, len(v)), shared.value)
        at = d.argmin(1)
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(d[np.arange(len(at)), at])], ["cell", "away"])

    members = built(vectors.withColumn("at", place("v")).select("at.cell", "at.away", "id", "v").repartition("cell").sortWithinPartitions("cell", "id"))
    radius = np.zeros(len(shared.value))
    for cell, away in members.groupBy("cell").agg(F.max("away")).collect():
        radius[cell] = away
    return Cells(shared.value, radius + SLACK, members.select("cell", "id", "v"))


def looked_up(cells: Cells, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, least: np.ndarray, k: int, digits: int) -> DataFrame:
    """(query_id, vec_id, score): of the cells that each query wants (query, cell) its vectors with scores of ``least`` or more, k of a batch at most."""
    shared = cells.members.sparkSession.sparkContext.broadcast((ids, q, wanted, least))

    def run(batches):
        ids, q, wanted, least = shared.value
        for batch in batches:
            cell, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            v = matrix(batch.column(2), len(keys)) if len(keys) else None
            cuts = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True) if len(keys) else ():
                who = np.flatnonzero(wanted[:, cell[a]])
                for part in (who[p : p + 512] for p in range(0, len(who), 512)):
                    scores = np.round(q[part] @ v[a:b].T, digits)
                    scores[(ids[part][:, None] == keys[a:b]) | (scores < least[part][:, None])] = -np.inf
                    if b - a > k:
                        kth = np.partition(scores, b - a - k, 1)[:, b - a - k]
                        scores[scores < kth[:, None]] = -np.inf
                    row, at = np.nonzero(scores > -np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part][row]), pa.array(keys[a:b][at]), pa.array(scores[row, at])], names=["query_id", "vec_id", "score"])

    return cells.members.mapInArrow(run, "query_id long, vec_id long, score double")


def bounds(cells: Cells, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How near each query is to each centroid, and the largest cosine that a vector of the cell can have."""
    d = distances(q, cells.centroids)
    least = np.maximum(d - cells.radius, 0)
    return d, 1 - least * least / 2


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, digits: int = 6, looked: list | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors nearest to each query but itself, by cosine rounded to so many digits, ties to the smaller id.

    Null, zero and not finite vectors take no part, on either side; vectors meet queries of their own
    dimension. Ids are unique. ``looked`` gets the numbers of (query, cell) pairs that were looked into, and of all.
    """
    data, asked = (sound(x, vec_id, embedding) for x in (vectors, queries))
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    for width in sorted(r[0] for r in asked.select(F.size("v")).distinct().collect()):
        cells = laid(data.filter(F.size("v") == width))
        if cells is None:
            continue
        own = asked.filter(F.size("v") == width)
        rounds = -(-own.count() // ROUND)
        for part in range(rounds):
            rows = own.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == part).orderBy("id").toArrow()
            if rows.num_rows:
                found = found.unionByName(search_round(cells, rows.column("id").to_numpy(), matrix(rows.column("v").combine_chunks(), rows.num_rows), k, digits, looked))
    return top(found, "query_id", "vec_id", k)


def search_round(cells: Cells, ids: np.ndarray, q: np.ndarray, k: int, digits: int, looked: list | None) -> DataFrame:
    d, bound = bounds(cells, q)
    nearest = np.argsort(d, 1, kind="stable")[:, :NEXT]
    first = np.zeros(d.shape, bool)
    np.put_along_axis(first, nearest, True, 1)
    any_score = np.full(len(ids), -np.inf)
    near = top(looked_up(cells, ids, q, first, any_score, k, digits), "query_id", "vec_id", k)
    least = any_score.copy()
    for query, score in near.filter(F.col("rank") == k).select("query_id", "score").collect():
        least[np.searchsorted(ids, query)] = score
    wanted = bound + SLACK >= least[:, None]
    if looked is not None:
        looked.append((int((wanted | first).sum()), wanted.size))
    return looked_up(cells, ids, q, wanted, least, k, digits)
