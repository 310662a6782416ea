"""Operator 7: approximate nearest neighbours by additive quantisation.

Codebooks hold full-dimensional codewords; a unit vector is encoded as the sum of one codeword from each,
found by beam search, and its code is stored with the norm of that sum. The codebooks are fitted on a
bounded sample of vectors, every vector is encoded. A query makes a table of its inner products with all
codewords; the sum of a code's table entries over the stored norm estimates the cosine. In each block of
vectors the best RERANK of each query are scored exactly, in double precision on the original vectors, and
the nearest of all blocks are kept.

Vectors are dealt to blocks by a hash of their id, so that rows don't depend on how the table is laid out.
Each block is shuffled once and meets all queries, which pass by it one after the other: what is shuffled
for the queries is their number times that of the blocks, and a task holds one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOOKS, WORDS = 16, 128
BEAM = 4
#: Vectors of which the codebooks are fitted, by a hash of the id.
SAMPLE = 8_192
ROUNDS = 6
#: Candidates of a query that are scored exactly, in each block of vectors.
RERANK = 96
#: Vectors that are encoded at once, and in a block: a 64th of them all between these bounds.
BLOCK, LARGEST = 4_096, 65_536
NEAREST, EVERY = 5, 50


def fitted(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (book, word, dimension) of unit vectors: residual k-means, then all codewords at once by least squares on beam-search codes."""
    n, d = x.shape
    if not n:
        return np.zeros((books, words, d), np.float32)
    rng = np.random.default_rng(7)
    rest, out = x.copy(), np.zeros((books, words, d), np.float32)
    for book in out:
        book[:] = rest[rng.choice(n, words, replace=n < words)]
        for _ in range(rounds):
            at = (rest @ book.T * 2 - (book**2).sum(1)).argmax(1)
            sums, count = np.zeros_like(book), np.bincount(at, minlength=words)
            np.add.at(sums, at, rest)
            full = count > 0
            book[full] = sums[full] / count[full, None]
        rest = rest - book[(rest @ book.T * 2 - (book**2).sum(1)).argmax(1)]
    places = encoded(x, out)[0].astype(np.int64) + np.arange(books) * words
    size = books * words
    # least squares: how often two codewords come together, and the sums of the vectors that have a codeword
    pairs = np.bincount((places[:, :, None] * size + places[:, None, :]).ravel(), minlength=size * size).reshape(size, size).astype(np.float64)
    sums = np.stack([np.bincount(places.ravel(), np.repeat(x[:, k], books), size) for k in range(d)], 1)
    ridge = 0.1
    out = np.linalg.solve(pairs + ridge * np.eye(size), sums + ridge * out.reshape(size, d)).reshape(out.shape).astype(np.float32)
    return out


def encoded(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vector, book) by beam search, and the norms of the sums that they stand for."""
    n, (m, k, d) = len(x), books.shape
    codes, rest = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    for book in books:
        error = (book**2).sum(1) - 2 * rest @ book.T + (rest**2).sum(2)[:, :, None]
        wide = error.reshape(n, -1)
        keep = min(beam, wide.shape[1])
        best = np.argpartition(wide, keep - 1, 1)[:, :keep]
        came, word = best // k, best % k
        codes = np.concatenate([np.take_along_axis(codes, came[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
        rest = np.take_along_axis(rest, came[:, :, None], 1) - book[word]
    best = (rest**2).sum(2).argmin(1)
    rows = np.arange(n)
    return codes[rows, best], np.linalg.norm(x - rest[rows, best], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def best_of(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best scores, ties to the smaller id."""
    if len(scores) <= keep:
        return np.arange(len(scores))
    least = np.partition(scores, -keep)[-keep]
    over, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    return np.concatenate([over, tied[np.argsort(ids[tied], kind="stable")][: keep - len(over)]])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of doubles, summed from the first component to the last."""
    return np.cumsum(a * b, axis=-1)[..., -1]


def sound(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): vectors of doubles that are neither null nor zero and have finite components only, with an id."""
    rows = vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", nearest: int = NEAREST, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the nearest of ``vectors`` but itself by cosine.

    Both have an id and an embedding; vectors that are null, zero or not finite, or have no id, take no
    part, on either side. A query meets the vectors of its own dimension. Equal scores go to the smaller id.
    A query with fewer candidates has them all. Repeated rows of an id count once, on either side: the
    least vector in order of its components. An empty table on either side gives an empty one.
    """
    data, asked = (sound(x, vec_id, embedding).groupBy("id").agg(F.min("v").alias("v")) for x in (vectors, queries))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in sorted(r[0] for r in asked.select(F.size("v")).distinct().collect()):
        same = F.size("v") == width
        found = found.unionByName(search_dimension(data.filter(same), asked.filter(same), width, nearest, rerank))
    return found


class Block:
    """A block of vectors in order of their ids, with codes and norms."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, books: np.ndarray):
        self.ids, self.v, self.flat = ids, v, books.reshape(-1, v.shape[1])
        self.lengths = np.sqrt(products(v, v))
        coded = [encoded(unit(v[k : k + BLOCK]), books) for k in range(0, len(v), BLOCK)]
        codes = np.concatenate([c for c, _ in coded])
        self.norms = np.maximum(np.concatenate([n for _, n in coded]), 1e-6)
        self.places = codes.T.astype(np.int64) + np.arange(len(books))[:, None] * books.shape[1]

    def nearest(self, query: int, q: np.ndarray, nearest: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the nearest vectors but the query's own, of the ``rerank`` best by their codes."""
        length = np.sqrt(products(q, q))
        table = self.flat @ (q / length).astype(np.float32)
        estimate = table[self.places].sum(0) / self.norms
        estimate[self.ids == query] = -np.inf
        at = best_of(estimate, self.ids, rerank)
        at = at[self.ids[at] != query]
        exact = products(self.v[at], q) / (self.lengths[at] * length)
        best = np.lexsort((self.ids[at], -exact))[:nearest]
        return self.ids[at][best], exact[best]


def search_dimension(data: DataFrame, asked: DataFrame, width: int, nearest: int, rerank: int) -> DataFrame:
    """``search`` among sound (id, v) of one dimension, each id once."""
    spark = data.sparkSession
    sample = data.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    fitting = sample.column("v").to_pylist()
    x = np.array(fitting, float).reshape(len(fitting), width)
    books = spark.sparkContext.broadcast(fitted(unit(x)) if len(x) else np.zeros((BOOKS, WORDS, width), np.float32))
    n = data.count()
    blocks = max(1, -(-n // min(LARGEST, max(BLOCK, n // 64))))

    def run(batches):
        block, parts, index = None, [], None
        for batch in batches:
            numbers, kinds, ids = (batch.column(k).to_numpy() for k in range(3))
            v = batch.column(3).flatten().to_numpy().reshape(len(ids), width)
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True) if len(ids) else ():
                if numbers[a] != block:
                    block, parts, index = numbers[a], [], None
                if kinds[a] == 0:
                    parts.append((ids[a:b], v[a:b]))
                    continue
                if index is None:
                    if not parts:
                        continue  # no vector has this block's number
                    index, parts = Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), books.value), []
                got = [index.nearest(i, q, nearest, rerank) for i, q in zip(ids[a:b], v[a:b], strict=True)]
                of = np.repeat(ids[a:b], [len(i) for i, _ in got])
                yield pa.RecordBatch.from_arrays([pa.array(of), *(pa.array(np.concatenate(x)) for x in zip(*got, strict=True))], names=["query_id", "vec_id", "score"])

    members = data.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    # A stated query set against all rows, in blocks
    probes = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")
    in_order = members.unionByName(probes).repartition("block").sortWithinPartitions("block", "kind", "id")
    found = in_order.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    """The five nearest vectors of every fiftieth vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
