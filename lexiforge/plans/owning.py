"""Queries of private search: items ask within documents of one source, which is their owner."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import private as P
from .retrieving import POSTINGS, indexed, items, read

#: The documents that an item names, some twice, some of another owner; some items name none.
IDS = "CASE WHEN item_id % 11 = 0 THEN array() ELSE concat(array(item_id % 20, item_id % 20 + 20, item_id % 20 + 40, item_id % 20 + 60, item_id % 20 + 80, item_id % 20 + 20), CASE WHEN item_id % 5 = 0 THEN array(item_id % 20 + 1) ELSE array() END) END"


def requests(spark, d):
    return items(spark, d).select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("owner"), F.expr(IDS).cast("array<bigint>").alias("ids"))


def owned(spark, d):
    return read(spark, d, "documents").select("doc_id", F.col("source").alias("owner"), (F.col("n_chars") >= 300).alias("ready"))


def private_access(spark, d):
    """Which items may search the documents that they name, and why others may not."""
    return P.access(requests(spark, d), owned(spark, d), "item_id").select("item_id", F.size("ids").cast("long").alias("named"), "reason")


def private_search(spark, d):
    """The eight best of the documents that an item names, by both arms; the vector of the item's number stands for its own."""
    asked, index = indexed(spark, d)
    v = read(spark, d, "embeddings").filter("embedding IS NOT NULL").select("vec_id", F.col("embedding").alias("v"))
    allowed = P.access(requests(spark, d), owned(spark, d), "item_id")
    # items without a vector, and items without terms
    own = v.withColumnRenamed("vec_id", "item_id").filter("item_id % 7 <> 2")
    return P.search(allowed, v.withColumnRenamed("vec_id", "doc_id"), asked.filter("item_id % 7 <> 4"), own, index, owned(spark, d), "item_id")


def _access() -> str:
    ids = "CASE WHEN item_id % 11 = 0 THEN [] ELSE list_sort(list_distinct([item_id % 20, item_id % 20 + 20, item_id % 20 + 40, item_id % 20 + 60, item_id % 20 + 80] || CASE WHEN item_id % 5 = 0 THEN [item_id % 20 + 1] ELSE [] END)) END"
    return f"""requests AS (SELECT item_id, 'src' || item_id % 20 AS owner, {ids} AS ids FROM benchmark),
    named AS (SELECT item_id, owner, unnest(ids) AS doc_id FROM requests),
    held AS (SELECT item_id, count(*) AS own, count(*) FILTER (n_chars >= 300) AS ready FROM named JOIN documents USING (doc_id) WHERE source = owner GROUP BY item_id),
    access AS (SELECT item_id, owner, len(ids) AS named, CASE WHEN len(ids) = 0 THEN 'nothing_selected' WHEN coalesce(own, 0) < len(ids) THEN 'unavailable' WHEN ready < len(ids) THEN 'not_ready' END AS reason FROM requests LEFT JOIN held USING (item_id))"""


_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_COSINE = f"{_DOT.format(a='e.embedding', b='x.embedding')} / sqrt({_DOT.format(a='e.embedding', b='e.embedding')} * {_DOT.format(a='x.embedding', b='x.embedding')})"
QUERIES = {
    "private_access": (private_access, f"WITH {_access()} SELECT item_id, named, reason FROM access"),
    "private_search": (
        private_search,
        f"""WITH {POSTINGS}, {_access()}, pairs AS (SELECT item_id, doc_id FROM named JOIN access USING (item_id) WHERE reason IS NULL),
        dense AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round({_COSINE}, 6) DESC, doc_id) AS r FROM pairs JOIN embeddings e ON e.vec_id = doc_id JOIN embeddings x ON x.vec_id = item_id WHERE item_id % 7 <> 2 QUALIFY r <= 8),
        s AS (SELECT item_id, doc_id, round(sum(p.tf * q.tf * idf), 6) AS score FROM pairs JOIN p USING (doc_id) JOIN q USING (item_id, term) JOIN w USING (term) WHERE item_id % 7 <> 4 GROUP BY ALL),
        sparse AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 8),
        joint AS (SELECT item_id, doc_id, dense.r AS dense_rank, sparse.r AS sparse_rank, round(coalesce(1.0::DOUBLE / (60 + dense.r), 0) + coalesce(1.0::DOUBLE / (60 + sparse.r), 0), 9) AS rrf FROM dense FULL JOIN sparse USING (item_id, doc_id)),
        f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, least(dense_rank, sparse_rank), doc_id) AS rank FROM joint QUALIFY rank <= 8)
        SELECT item_id, doc_id, rank, rrf, dense_rank, sparse_rank, CASE WHEN count(dense_rank) OVER (PARTITION BY item_id) = 0 THEN 'sparse_fallback' WHEN count(sparse_rank) OVER (PARTITION BY item_id) = 0 THEN 'dense_fallback' ELSE 'hybrid' END AS mode FROM f""",
    ),
}
