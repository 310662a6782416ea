"""Search among documents that a request names and its owner has: access first, then both arms on those documents only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import built
from . import impacts as I
from . import retrieval as R

TOP = 8


def access(requests: DataFrame, docs: DataFrame, request: str = "request_id") -> DataFrame:
    """(request, owner, ids, reason) of requests (request, owner, ids array): why one is refused, or null.

    All documents that a request names must be its owner's and ready; a foreign one and one that isn't there
    are told apart by nothing. ``docs`` has doc_id, owner and ready.
    """
    named = requests.select(request, "owner", F.array_sort(F.array_distinct(F.coalesce("ids", F.array().cast("array<bigint>")))).alias("ids"))
    each = named.select(request, "owner", F.explode("ids").alias("doc_id")).join(docs.select("doc_id", "owner", "ready"), ["doc_id", "owner"])
    held = each.groupBy(request).agg(F.count("*").alias("own"), F.count_if("ready").alias("ready"))
    n, met = F.size("ids"), named.join(held, request, "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    reason = F.when(n == 0, "nothing_selected").when(count("own") < n, "unavailable").when(count("ready") < n, "not_ready")
    return met.select(request, "owner", "ids", reason.alias("reason"))


def search(allowed: DataFrame, vectors: DataFrame, asked: DataFrame, asked_vectors: DataFrame, index: I.Index, docs: DataFrame, request: str = "request_id", k: int = TOP) -> DataFrame:
    """(request, doc_id, rank, rrf, dense_rank, sparse_rank, mode): the k best of the documents that each allowed request names.

    ``asked`` (request, term, tf) are the requests' postings, ``asked_vectors`` (request, v) their vectors,
    ``vectors`` (doc_id, v). An arm that a request has no vector or no terms for is left out; ``mode`` says
    which arms spoke. Hits are taken from ``docs`` again, as their owner's and ready, so that one that has
    changed since is left out; ranks keep their gaps.
    """
    pairs = built(allowed.filter("reason IS NULL").select(request, "owner", F.explode("ids").alias("doc_id")))
    met = pairs.join(asked_vectors.select(request, F.col("v").alias("q")), request).join(vectors.select("doc_id", "v"), "doc_id")
    sound = met.filter(F.exists("v", lambda x: x != 0) & F.exists("q", lambda x: x != 0) & (F.size("v") == F.size("q")))
    dense = R.top(sound.select(request, "doc_id", F.round(T.cosine(F.col("v"), F.col("q")), 6).alias("score")), request, "doc_id", k)
    weights = I.if_small(built(asked.join(index.frequencies(), "term").select(request, "term", (F.col("tf") * F.col("idf")).alias("q"))), I.BROADCAST_ROWS)
    sparse = R.top(I.scored(index, pairs.select(request, "doc_id"), weights, request, I.tf), request, "doc_id", k)
    fused = R.fuse(dense, sparse, [request, "doc_id"]).filter(F.col("fused_rank") <= k)
    own = docs.filter("ready").select("doc_id", "owner")
    hits = fused.join(pairs, [request, "doc_id"]).join(own, ["doc_id", "owner"], "left_semi")
    arms = hits.groupBy(request).agg(F.count("first_rank").alias("a"), F.count("second_rank").alias("b"))
    mode = F.when(F.col("a") == 0, "sparse_fallback").when(F.col("b") == 0, "dense_fallback").otherwise("hybrid")
    return hits.join(arms, request).select(request, "doc_id", F.col("fused_rank").cast("long").alias("rank"), "rrf", F.col("first_rank").cast("long").alias("dense_rank"), F.col("second_rank").cast("long").alias("sparse_rank"), mode.alias("mode"))
