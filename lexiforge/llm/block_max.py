"""Operator 13: ranked lexical search by variable-block-max WAND.

A first pass splits the texts into terms and keeps, per document, its length and the terms that any item asks
for, as numbers, in a table; from it come the numbers of documents, terms, and documents with a term. Each task
then reads its part of the table in shards of a bounded number of postings, and searches each for all items; the
twenty best of a task pass from shard to shard, so that later shards skip more, and only they leave the task.

Within a shard a term's postings are cut into blocks. A block is known by its largest impact; how far the
documents that it spans lie below that, those without the term included, is its bound error. Dynamic programming chooses the cuts that make the sum
of errors, plus a price per block, least, among all cuts into blocks of at most LONGEST postings. The ends of
the blocks of an item's terms part the shard into intervals, whose bound is the sum of the maxima of the blocks
that reach over them. WAND's pivot moves over intervals instead of documents: an interval whose bound is
below the twentieth best score is skipped, and so are the blocks that reach over skipped ones only. Intervals
are taken from the highest bound on, the threshold rises in between; equal to it isn't below it, as
ties go to the smaller id. So rows are exact, whatever the shards.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, checkpoint

TOP = 20
#: Bytes of texts that are split at once; a longer text stands alone.
BYTES = 4 << 20
#: Postings of a shard.
SHARD = 3_000_000
#: Postings of a block at most, and what a block costs, in mean impacts of its list.
LONGEST, PRICE = 64, 4
#: Bytes of items that are searched for at once: their terms and statistics are broadcast.
ROUND_BYTES = 16 << 20
#: Intervals that are scored first; their number doubles from step to step.
FIRST = 64

#: Bytes as terms have them: ASCII letters in lower case, digits, and all that isn't ASCII; others part terms.
FOLDED = np.array([b if b >= 128 or chr(b).isdigit() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256)], np.uint8)

PACKED = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item_id long, doc_id long, score long"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, and the number of each one's text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    folded = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(FOLDED[raw]))
    lists = pc.ascii_split_whitespace(folded)
    flat, of = lists.flatten(), np.asarray(pc.list_parent_indices(lists), np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), of[np.asarray(full)]


def split_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term, times): the terms of each item; of repeated rows of an id the least text counts."""
    one = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            found, of = terms_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), found], names=["item_id", "term"])

    return one.mapInArrow(run, "item_id long, term string").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def packed(docs: DataFrame, doc_id: str, text: str, asked: list[str]) -> DataFrame:
    """PACKED: per document with a term its number of terms, and which of ``asked`` it has how often."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(asked, pa.string()))

    def run(batches):
        words = shared.value
        size = max(1, len(words))
        for batch in batches:
            ids, texts = batch.columns
            for a, b in by_bytes(texts, BYTES):
                found, of = terms_of(texts.slice(a, b - a))
                n = np.bincount(of, minlength=b - a)
                number = pc.index_in(found, words)
                known = np.asarray(pc.is_valid(number))
                keys, tfs = np.unique(of[known] * size + np.asarray(number.filter(pa.array(known)), np.int64), return_counts=True)
                own, terms = np.divmod(keys, size)
                ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=b - a))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (terms, tfs)]
                out = pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PACKED)


def block_starts(impacts: np.ndarray, docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int = LONGEST, price: float = PRICE) -> np.ndarray:
    """Which postings begin a block, of lists ``impacts[starts:ends]`` that lie one after the other: the cuts with the least sum of bound errors and prices.

    All lists go through the programme together, longest first, posting by posting. A block of postings i to
    j - 1 costs the documents that it spans times its maximum, less its impacts, plus the price; the impacts
    add up to the same for all cuts and are left out. Slot i % longest holds posting i's document, the maximum
    since then, and the least cost of the postings before it.
    """
    first = np.zeros(len(impacts), bool)
    if not len(starts):
        return first
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    fee = 1 + np.round(price * np.add.reduceat(impacts, starts)[order] / lengths[order]).astype(np.int64)
    starts, lengths = starts[order], lengths[order]
    far = np.int64(1) << 60
    before = np.full((len(starts), longest), far)
    top = np.zeros((len(starts), longest), np.int64)
    since = np.zeros((len(starts), longest), np.int64)
    before[:, 0] = 0
    back = np.zeros(len(impacts), np.uint16)
    slots = np.arange(longest)
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # lists longer than each step
    for j in range(1, int(lengths[0]) + 1):
        a = int(active[j - 1])
        at = starts[:a] + j - 1
        new = (j - 1) % longest
        top[:a, new] = 0
        since[:a, new] = docs[at]
        np.maximum(top[:a], impacts[at][:, None], out=top[:a])
        cost = (docs[at] + 1)[:, None] - since[:a]
        cost *= top[:a]
        cost += before[:a]
        best = cost.argmin(1)
        back[at] = (j - 1 - slots[best]) % longest + 1
        before[:a, j % longest] = cost[np.arange(a), best] + fee[:a]
    at = lengths.copy()
    rows = np.arange(len(at))
    while len(rows):
        at[rows] -= back[starts[rows] + at[rows] - 1]
        first[starts[rows] + at[rows]] = True
        rows = rows[at[rows] > 0]
    return first


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to its end."""
    sizes = ends - starts
    skip = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - skip, sizes)


class Shard:
    """Postings of some documents, in blocks of variable size with their maxima."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, documents: int, total: int, size: int, longest: int = LONGEST):
        self.ids, self.read = ids, 0
        m = 75 + 25 * n * documents // total
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(terms, kind="stable")
        self.doc, tf = doc[order], tfs[order].astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc])
        ends = np.cumsum(np.bincount(terms, minlength=size))
        starts = np.concatenate([[0], ends[:-1]])
        full = ends > starts
        begins = np.flatnonzero(block_starts(self.impact, self.doc, starts[full], ends[full], longest))
        self.start, self.end = begins, np.append(begins[1:], len(self.doc))
        self.top = np.maximum.reduceat(self.impact, begins) if len(begins) else begins
        #: the blocks of each term
        self.blocks = np.searchsorted(begins, np.concatenate([[0], ends]))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, ids) of documents so far with those of this shard, the ``top`` of them."""
        a, b = self.blocks[terms], self.blocks[terms + 1]
        block, weight = ranges(a, b), np.repeat(weights, b - a)
        if not len(block):
            return best
        start, end = self.start[block], self.end[block]
        first, last = self.doc[start], self.doc[end - 1] + 1
        bound = self.top[block] * weight
        cuts, at = np.unique(np.concatenate([first, last]), return_inverse=True)
        bounds = np.zeros(len(cuts), np.int64)
        np.add.at(bounds, at, np.concatenate([bound, -bound]))
        bounds = np.cumsum(bounds)[:-1]
        order, step = np.argsort(-bounds, kind="stable"), FIRST
        bounds = bounds[order]
        from_cut, to_cut = at[: len(block)], at[len(block) :]
        while len(order):
            threshold = best[0][-1] if len(best[0]) == top else 1
            order = order[: np.searchsorted(-bounds, -threshold, "right")]
            bounds = bounds[: len(order)]
            now, order, bounds = order[:step], order[step:], bounds[step:]
            step *= 2
            live = np.zeros(len(cuts), bool)
            live[now] = True
            upto = np.concatenate([[0], np.cumsum(live)])
            touched = upto[to_cut] > upto[from_cut]
            posting = ranges(start[touched], end[touched])
            self.read += len(posting)
            doc, w = self.doc[posting], np.repeat(weight[touched], (end - start)[touched])
            inside = live[np.searchsorted(cuts, doc, "right") - 1]
            own, place = np.unique(doc[inside], return_inverse=True)
            score = np.zeros(len(own), np.int64)
            np.add.at(score, place, w[inside] * self.impact[posting[inside]])
            best = merged(best, (score, self.ids[own]), top)
        return best


def merged(best: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
    score, ids = np.concatenate([best[0], more[0]]), np.concatenate([best[1], more[1]])
    if len(score) > top:
        least = np.partition(score, -top)[-top]
        ids, score = ids[score >= least], score[score >= least]
    order = np.lexsort((ids, -score))
    order = order[score[order] > 0][:top]
    return score[order], ids[order]


def searched(table: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], documents: int, total: int, size: int, top: int, longest: int, postings: int) -> DataFrame:
    """FOUND: each task's best documents of each item."""
    shared = table.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        asked = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        parts, held = [], 0

        def search():
            shard = Shard(*(np.concatenate(x) for x in zip(*parts, strict=True)), documents, total, size, longest)
            for k, (_, terms, weights) in enumerate(asked):
                best[k] = shard.search(terms, weights, best[k], top)

        for batch in batches:
            ids, n, terms, tfs = batch.columns
            counts = np.asarray(pc.list_value_length(terms), np.int64)
            parts.append((ids.fill_null(np.iinfo(np.int64).max).to_numpy(), n.to_numpy(), counts, terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            held += int(counts.sum())
            if held >= postings:
                search()
                parts, held = [], 0
        if parts:
            search()
        of = np.repeat(np.arange(len(asked)), [len(s) for s, _ in best])
        if len(of):
            score, ids = (np.concatenate(x) for x in zip(*best, strict=True))
            null = ids == np.iinfo(np.int64).max
            items = pa.array([asked[k][0] for k in of], pa.int64())
            yield pa.RecordBatch.from_arrays([items, pa.array(ids, mask=null), pa.array(score)], names=["item_id", "doc_id", "score"])

    return table.mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, longest: int = LONGEST, postings: int = SHARD) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``top`` highest-scoring documents with a score above 0.

    Equal scores go to the smaller id, a null id last. Repeated rows of a document's id are documents of their
    own. Texts and items that are null or have no term find nothing and aren't found. Items of more bytes than
    a round holds are searched for in rounds. Empty tables on either side give an empty one; other columns
    are left out, whatever their names.
    """
    spark = docs.sparkSession
    wanted = checkpoint(split_items(items, item_id, item_text))
    size = wanted.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    rounds = -(-size // ROUND_BYTES)
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(rounds):
        found = found.unionByName(search_round(docs, wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k), doc_id, text, top, longest, postings))
    return found


def search_round(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, top: int, longest: int, postings: int) -> DataFrame:
    rows = wanted.toArrow().sort_by([("item_id", "ascending"), ("term", "ascending")])
    asked = sorted(set(rows.column("term").to_pylist()))
    table = checkpoint(packed(docs, doc_id, text, asked))
    documents, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(len(asked), np.int64)
    for term, n in table.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[term] = n
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
    number = {t: k for k, t in enumerate(asked)}
    by_item: dict[int, list[tuple[int, int]]] = {}
    for item, term, times in zip(*(c.to_pylist() for c in rows.columns), strict=True):
        by_item.setdefault(item, []).append((number[term], times))
    questions = [(item, np.array([t for t, _ in of]), np.array([weight[t] * times for t, times in of])) for item, of in by_item.items()]
    best = searched(table.filter(F.size("terms") > 0), questions, documents, total, len(asked), top, longest, postings)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir):
    """The twenty best of all documents for each benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
