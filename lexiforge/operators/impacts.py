"""Lexical search on postings in order of impact, with a bound for what isn't read.

Postings of a term are laid in layers by how often a document has it, which is the order of their impact; a
layer is cut into blocks of bounded size by a hash of the document, so that a frequent term lies in many tasks.
All postings of a layer have the same impact, so that a layer's bound is exact.

A query is answered in two steps. First its strongest blocks are read, their best documents are scored in full,
and the k-th best score becomes a threshold that the answer can't fall below. Then each term's layers are left
unread from the weakest on, those first that save the most rows for the bound they cost, while the sum of the
bounds stays below a share of the threshold: a document that has nothing but unread postings can't reach it. What the read
layers say of a document, plus that sum, bounds its score; only documents that may reach the threshold are
scored in full, from the row that holds all their terms. The answer is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.shared import built
from . import retrieval as R

#: Postings of a block, about.
BLOCK = 1_024
#: Postings of the blocks that a query reads for its threshold, about, and documents that are scored in full for it.
FIRST_ROWS, FIRST_DOCS = 4_096, 64
#: The share of the threshold up to which bounds of unread layers add up: the more, the fewer postings are read, but the more documents may reach it.
SHARE = 0.7
#: Terms that a worker counts at once.
SLICE = 250_000
#: Scores are compared after rounding to six digits.
SLACK = 2e-6
#: Terms, terms of queries, candidates and large layers are broadcast if there are no more, else shuffled.
BROADCAST_ROWS = 500_000


def slices(lists: pa.Array, most: int) -> list[tuple[int, int]]:
    """(offset, rows) of slices of an array of lists that have ``most`` elements each at most, or one list; one slice at least."""
    ends, out, k = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)), [], 0
    while k < len(lists) or not out:
        before = ends[k - 1] if k else 0
        upto = max(k + 1, int(np.searchsorted(ends, before + most, "right")))
        out.append((k, min(upto, len(lists)) - k))
        k = upto
    return out


def counted(words: Column, among: list[str] | None) -> Column:
    """A row's distinct terms, those of ``among`` where given, with their numbers: array<struct<term, n>>."""
    known = None if among is None else pa.array(among, pa.string())

    def part(lists: pa.Array) -> pa.Array:
        flat, of = lists.flatten(), np.asarray(pc.list_parent_indices(lists), np.int64)
        dictionary = flat.unique() if known is None else known
        number = pc.index_in(flat, dictionary)
        there = np.asarray(pc.is_valid(number))
        size = max(1, len(dictionary))
        keys, n = np.unique(of[there] * size + np.asarray(number.filter(pa.array(there)), np.int64), return_counts=True)
        own, word = np.divmod(keys, size)
        ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(lists)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([dictionary.take(pa.array(word)), pa.array(n)], ["term", "n"]))

    @F.arrow_udf("array<struct<term: string, n: bigint>>")
    def run(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(lists.slice(k, rows)) for k, rows in slices(lists, SLICE)])

    return run(F.coalesce(words, F.array().cast("array<string>")))


def if_small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has no more rows than ``most``."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tf(n: Column | str) -> Column:
    """Sub-linear term frequency."""
    return 1 + F.log(n)


@dataclass
class Index:
    """Documents with their terms, blocks of postings, sizes of layers; ids are unique."""

    documents: int
    #: (doc_id, terms array<struct<term, n>>)
    rows: DataFrame
    #: (term, n, size): how many documents have a term n times
    layers: DataFrame
    #: (term, n, block, docs array)
    blocks: DataFrame

    def frequencies(self) -> DataFrame:
        """(term, n, idf)."""
        held = self.layers.groupBy("term").agg(F.sum("size").alias("n"))
        return held.withColumn("idf", F.log(1 + (self.documents - F.col("n") + 0.5) / (F.col("n") + 0.5)))


def index(docs: DataFrame, asked: DataFrame, doc_id: str = "doc_id", body: str = "text") -> Index:
    """An index of ``docs`` for the terms in ``asked`` (term), or of all terms where these are too many: each table is written once."""
    terms = asked.select("term").distinct()
    first = terms.limit(BROADCAST_ROWS + 1).toArrow().column(0).to_pylist()
    found = counted(text.terms(F.col(body)), first if len(first) <= BROADCAST_ROWS else None)
    rows = built(docs.select(F.col(doc_id).alias("doc_id"), found.alias("terms")))
    each = rows.select("doc_id", F.inline("terms"))
    layers = built(each.groupBy("term", "n").agg(F.count("*").alias("size")))
    large = layers.filter(F.col("size") > BLOCK).withColumn("cuts", F.ceil(F.col("size") / BLOCK))
    cut = each.join(if_small(large.select("term", "n", "cuts"), BROADCAST_ROWS), ["term", "n"], "left")
    block = F.when(F.col("cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("cuts")))
    blocks = built(cut.groupBy("term", "n", block.cast("long").alias("block")).agg(F.collect_list("doc_id").alias("docs")))
    return Index(rows.count(), rows, layers, blocks)


def scored(found: Index, candidates: DataFrame, weights: DataFrame, query_id: str, impact) -> DataFrame:
    """(query, doc_id, score): full scores of ``candidates`` (query, doc_id), from the rows of their documents."""
    met = found.rows.join(if_small(candidates, BROADCAST_ROWS), "doc_id").select(query_id, "doc_id", F.inline("terms"))
    full = met.join(weights, [query_id, "term"]).groupBy(query_id, "doc_id").agg(F.sum(impact("n") * F.col("q")).alias("score"))
    return full.withColumn("score", F.round("score", 6))


def partial(blocks: DataFrame, query_id: str, impact) -> DataFrame:
    """(query, doc_id, part): what some blocks (query, n, q, docs) say of each document."""
    each = blocks.select(query_id, (impact("n") * F.col("q")).alias("s"), F.explode("docs").alias("doc_id"))
    return each.groupBy(query_id, "doc_id").agg(F.sum("s").alias("part"))


def thresholds(found: Index, weights: DataFrame, query_id: str, k: int, impact) -> DataFrame:
    """(query, least): a score that the query's k-th best document has at least; no row where fewer than k were found."""
    sizes = found.layers.join(weights, "term").withColumn("worth", impact("n") * F.col("q"))
    strongest = Window.partitionBy(query_id).orderBy(F.desc("worth"), "size", "term", "n").rowsBetween(Window.unboundedPreceding, -1)
    chosen = sizes.withColumn("before", F.coalesce(F.sum(F.least("size", F.lit(BLOCK))).over(strongest), F.lit(0))).filter(F.col("before") < FIRST_ROWS)
    first = found.blocks.filter("block = 0").join(if_small(chosen.select(query_id, "term", "n", "q"), BROADCAST_ROWS), ["term", "n"])
    best = Window.partitionBy(query_id).orderBy(F.desc("part"), "doc_id")
    candidates = partial(first, query_id, impact).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= FIRST_DOCS)
    full = scored(found, built(candidates.select(query_id, "doc_id")), weights, query_id, impact)
    ranked = full.withColumn("r", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"))))
    return ranked.filter(F.col("r") == k).select(query_id, F.col("score").alias("least"))


def unread(found: Index, weights: DataFrame, least: DataFrame, query_id: str, impact) -> DataFrame:
    """(query, term, upto, bound, least): layers of a query's term up to ``upto`` needn't be read; the largest ``bound`` is what all unread ones of the query add to a score at most.

    Layers of a term are left out from the weakest on. A layer's price is what the bound grows by; those with
    the most rows for their price go first, none before the weaker ones of its term.
    """
    layers = found.layers.join(weights, "term").join(least, query_id)
    up = Window.partitionBy(query_id, "term").orderBy("n")
    priced = layers.withColumn("price", F.col("q") * (impact("n") - F.coalesce(F.lag(impact("n")).over(up), F.lit(0.0))))
    gain = F.when(F.col("price") > 0, F.col("size") / F.col("price")).otherwise(F.lit(float("inf")))
    ordered = priced.withColumn("gain", gain).withColumn("gain", F.min("gain").over(up))
    cheapest = Window.partitionBy(query_id).orderBy(F.desc("gain"), "term", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = ordered.withColumn("bound", F.sum("price").over(cheapest)).filter(F.col("bound") + SLACK < SHARE * F.col("least"))
    return left.groupBy(query_id, "term").agg(F.max("n").alias("upto"), F.max("bound").alias("bound"), F.max("least").alias("least"))


def best(found: Index, weights: DataFrame, query_id: str, k: int = R.DEPTH, impact=tf, read: list | None = None) -> DataFrame:
    """(query, doc_id, score, rank): the k documents with the largest sums of q x impact(n), where n is how often a document has a term of ``weights`` (query, term, q).

    ``impact`` doesn't fall with n. Sums are rounded to six digits, equal ones go to the smaller id. ``read``
    gets the number of postings that the query reads, and that it would read without thresholds.
    """
    weights = if_small(built(weights), BROADCAST_ROWS)
    cuts = unread(found, weights, thresholds(found, weights, query_id, k, impact), query_id, impact)
    wanted = built(weights.join(cuts, [query_id, "term"], "left").withColumn("upto", F.coalesce("upto", F.lit(0))))
    met = found.blocks.join(if_small(wanted.drop("bound", "least"), BROADCAST_ROWS), "term")
    if read is not None:
        read.append(tuple(met.agg(F.sum(F.when(F.col("n") > F.col("upto"), F.size("docs")).otherwise(0)), F.sum(F.size("docs"))).first()))
    parts = partial(met.filter(F.col("n") > F.col("upto")), query_id, impact)
    # a query that leaves nothing unread has all its scores in ``parts``, and no threshold is needed
    slack = wanted.groupBy(query_id).agg(F.max("bound").alias("bound"), F.max("least").alias("least")).filter("least IS NOT NULL")
    able = F.col("least").isNull() | (F.col("part") + F.col("bound") + SLACK >= F.col("least"))
    candidates = built(parts.join(if_small(slack, BROADCAST_ROWS), query_id, "left").filter(able).select(query_id, "doc_id"))
    return R.top(scored(found, candidates, weights, query_id, impact), query_id, "doc_id", k)


def search(found: Index, queries: DataFrame, query_id: str, k: int = R.DEPTH, read: list | None = None) -> DataFrame:
    """The k best documents by query tf x document tf x idf; ``queries`` (query, term, tf) are postings of queries."""
    weights = queries.join(found.frequencies(), "term").select(query_id, "term", (F.col("tf") * F.col("idf")).alias("q"))
    return best(found, weights, query_id, k, tf, read)


def overlap(found: Index, queries: DataFrame, query_id: str, k: int = R.DEPTH) -> DataFrame:
    """The k documents with the most distinct terms of a query."""
    return best(found, queries.select(query_id, "term", F.lit(1.0).alias("q")), query_id, k, lambda n: F.when(F.col(n) > 0, 1.0))
