"""Operator 3: toxicity by class-conditional Kneser-Ney models.

A text's words are read twice: whole, and as chains of four-letter pieces, so that inflected forms which
the sample hasn't shown share their stem's evidence. For each reading there is a toxic and an ordinary
Kneser-Ney model; both discount their own counts and back off to the same pooled counts, whose last
level are continuation counts, so that a rare expression scores alike in both. A text's log-likelihood
ratios, normalised by its length, are calibrated by a logistic regression on rows that the counts
haven't seen.

The models are fitted on a bounded sample of labelled rows: ``most_toxic`` and ``most_ordinary`` rows at
most, by a hash of the id, and only of rows outside the held-out fold. A document counts a word once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, sliced

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
MOST_TOXIC, MOST_ORDINARY = 5_000, 10_000
PIECE = 4
#: A log-likelihood ratio above this is evidence of its own, beside the mean over the text.
STRONG = 3.0
CACHED_CHUNKS = 75_000
#: Distinct counts that a task gathers before it hands them on.
GATHERED = 50_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def grams(word: str) -> list[tuple[str, str, str]]:
    """(reading, context, symbol) of a word: itself, then its pieces after the piece before."""
    pieces = [word[i : i + PIECE] for i in range(0, len(word), PIECE)]
    return [("w", "", word), *(("p", a, b) for a, b in zip(["", *pieces], pieces, strict=False))]


class KneserNey:
    """Two class-conditional models of one reading over shared backoff counts."""

    def __init__(self, counts: tuple[dict, dict]):
        self.counts = counts
        self.pool = Counter(counts[0]) + Counter(counts[1])
        follow = Counter(b for _, b in self.pool)
        self.follow, self.types = follow, max(1, sum(follow.values()))
        self.floor = (len(follow) or 1) / ((len(follow) + 1) * self.types)
        self.total = [Counter(), Counter()]
        self.distinct = [Counter(), Counter()]
        self.discount = []
        for k, own in enumerate(counts):
            for (a, _), c in own.items():
                self.total[k][a] += c
                self.distinct[k][a] += 1
            once, twice = (sum(c == n for c in own.values()) for n in (1, 2))
            self.discount.append(once / (once + 2 * twice) if once else 0.5)
        self.pooled, self.pooled_distinct = self.total[0] + self.total[1], Counter(a for a, _ in self.pool)
        once, twice = (sum(c == n for c in self.pool.values()) for n in (1, 2))
        self.pool_discount = once / (once + 2 * twice) if once else 0.5

    def shared(self, a: str, b: str) -> float:
        d = self.pool_discount
        last = max(self.follow.get(b, 0) - d, 0) / self.types + d * self.floor
        if not (n := self.pooled.get(a)):
            return last
        return max(self.pool.get((a, b), 0) - d, 0) / n + d * self.pooled_distinct[a] / n * last

    def ratio(self, a: str, b: str) -> float:
        """Log of the toxic over the ordinary probability of ``b`` after ``a``."""
        base, p = self.shared(a, b), []
        for k in (0, 1):
            n, d = self.total[k].get(a, 0), self.discount[k]
            p.append(max(self.counts[k].get((a, b), 0) - d, 0) / n + d * self.distinct[k][a] / n * base if n else base)
        return math.log(p[1] / p[0])

    def escape(self, a: str) -> float:
        """The ratio of every symbol that hasn't come after ``a``: the shared backoff cancels out."""
        p = [self.discount[k] * self.distinct[k][a] / n if (n := self.total[k].get(a, 0)) else 1.0 for k in (0, 1)]
        return math.log(p[1] / p[0])


@dataclass
class Model:
    """Ratios of words in both readings, and the calibration; ``prior`` where there are not two classes."""

    seen: dict[str, float]  # of whole words, in either class's sample
    unseen: float
    pieces: dict[str, float]  # of a piece after another, joined by a line end
    escapes: dict[str, float]  # of a piece that hasn't come after another
    prior: float
    weights: np.ndarray | None = None
    cache: dict[str, int] = field(default_factory=dict, repr=False)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 7), np.float32), repr=False)
    #: The cache before, from which chunks that come again are taken over.
    old: tuple[dict, np.ndarray] = field(default_factory=lambda: ({}, np.zeros((0, 7), np.float32)), repr=False)

    def __getstate__(self):
        none = np.zeros((0, 7), np.float32)
        return {**self.__dict__, "cache": {}, "table": none, "old": ({}, none)}

    def chunk(self, chunk: str) -> tuple[float, ...]:
        """Words, then per reading the sum of ratios, the sum of strong ones and the largest."""
        found = _LETTERS.findall(chunk.lower())
        if not found:
            return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
        seen, unseen, pieces, escapes = self.seen, self.unseen, self.pieces, self.escapes
        whole, whole_strong, whole_top, parts, parts_strong, parts_top = 0.0, 0.0, -math.inf, 0.0, 0.0, -math.inf
        for w in found:
            r = seen.get(w, unseen)
            whole += r
            if r > whole_top:
                whole_top = r
            if r > STRONG:
                whole_strong += r
            total, before = 0.0, ""
            for i in range(0, len(w), PIECE):
                piece = w[i : i + PIECE]
                r = pieces.get(f"{before}\n{piece}")
                total += escapes.get(before, 0.0) if r is None else r
                before = piece
            parts += total
            if total > parts_top:
                parts_top = total
            if total > STRONG:
                parts_strong += total
        return (len(found), whole, whole_strong, whole_top, parts, parts_strong, parts_top)

    def features(self, text: str) -> list[float]:
        if len(self.cache) > CACHED_CHUNKS:
            self.old, self.cache, self.table = (self.cache, self.table), {}, np.zeros((0, 7), np.float32)
        cache, at, new = self.cache, [], []
        before, rows = self.old
        for c in text.split():
            if (k := cache.get(c)) is None:
                k = cache[c] = len(cache)
                new.append(self.chunk(c) if (j := before.get(c)) is None else rows[j])
            at.append(k)
        if new:
            first = len(cache) - len(new)
            if len(cache) > len(self.table):
                grown = np.zeros((2 * len(cache), 7), np.float32)
                grown[:first] = self.table[:first]
                self.table = grown
            self.table[first : len(cache)] = new
        got = self.table[at] if at else np.zeros((1, 7), np.float32)
        n, sums, largest = max(1.0, got[:, 0].sum(dtype=float)), got.sum(0, dtype=float), got.max(0)
        return [x for k in (1, 4) for x in (sums[k] / n, sums[k + 1] / math.sqrt(n), float(largest[k + 2]))]

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + self.weights[1:] @ np.array(self.features(text)))))))


def calibrated(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Intercept and weights of a ridge logistic regression, by Newton's steps."""
    mean, deviation = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / deviation]
    ridge = penalty * np.diag([0.0] + [1.0] * x.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
    slopes = w[1:] / deviation
    return np.r_[w[0] - slopes @ mean, slopes]


def training_rows(docs, labels, doc_id, text, label, most_toxic, most_ordinary) -> DataFrame:
    """(text, toxic, calibration) of the sample. Of several labels of an id the largest holds."""
    known = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.max(label).cast("int").alias("__toxic"))
        .filter(fold(F.col("__id"), FOLDS) != HELD_OUT)
    )
    by_hash = [F.xxhash64("__id"), "__id"]
    sample = known.filter("__toxic > 0").orderBy(*by_hash).limit(most_toxic).unionAll(known.filter("__toxic <= 0").orderBy(*by_hash).limit(most_ordinary))
    # most_toxic + most_ordinary ids at most
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(sample), "__id").select(
        F.coalesce("__text", F.lit("")).alias("text"),
        (F.col("__toxic") > 0).cast("int").alias("toxic"),
        (fold(F.col("__id"), FOLDS) == CALIBRATION).alias("calibration"),
    )


def fit(docs, labels, doc_id="doc_id", text="text", label="toxic", most_toxic=MOST_TOXIC, most_ordinary=MOST_ORDINARY) -> Model:
    """The model from ``labels`` (doc_id, toxic) outside the held-out fold; with fewer than two classes, their share."""
    spark = docs.sparkSession
    rows = training_rows(docs, labels, doc_id, text, label, most_toxic, most_ordinary)

    def count(batches):
        found: Counter = Counter()

        def summed():
            keys = list(zip(*found, strict=True)) or [[]] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in zip([*keys, list(found.values())], [pa.string()] * 3 + [pa.int32(), pa.int64()], strict=True)], names=["reading", "a", "b", "toxic", "n"])
            found.clear()
            return batch

        for batch in sliced(batches):
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[("n", "", "", toxic)] += 1
                for g in {g for w in set(words(t)) for g in grams(w)}:
                    found[(*g, toxic)] += 1
            if len(found) > GATHERED:
                yield summed()
        yield summed()

    schema = "reading string, a string, b string, toxic int, n long"
    counts = rows.filter("not calibration").mapInArrow(count, schema).groupBy("reading", "a", "b", "toxic").agg(F.sum("n").alias("n")).toArrow()
    by = {"n": ({}, {}), "w": ({}, {}), "p": ({}, {})}
    for batch in counts.to_batches(65_536):
        for reading, a, b, toxic, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            by[reading][toxic][(a, b)] = n
    del counts
    ordinary, toxic = (sum(x.values()) for x in by["n"])
    # without two classes no row is called toxic
    prior = min(0.49, toxic / (ordinary + toxic + 2))
    if not ordinary or not toxic:
        return Model({}, 0.0, {}, {}, prior)
    whole, pieces = KneserNey(by.pop("w")), KneserNey(by.pop("p"))
    unseen = whole.escape("")
    seen = {b: r for a, b in whole.pool if abs((r := whole.ratio(a, b)) - unseen) > 1e-6}
    model = Model(seen, unseen, {f"{a}\n{b}": pieces.ratio(a, b) for a, b in pieces.pool}, {a: pieces.escape(a) for a in pieces.pooled}, prior)
    del whole, pieces
    shared = spark.sparkContext.broadcast(model)

    def look(batches):
        for batch in sliced(batches):
            x = [shared.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    found = rows.filter("calibration").select("text", "toxic").mapInArrow(look, "x array<double>, toxic int").toArrow()
    y = np.array(found.column(1).to_pylist(), float)
    shared.destroy()
    if len(y) == 0 or y.min() == y.max():
        return Model({}, 0.0, {}, {}, prior)
    model.weights = calibrated(np.array(found.column(0).to_pylist()), y)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column ``name`` from 0 to 1, higher where label 1 is likelier, of each whole text.

    Null and empty texts have the score of a text without words. Rows are independent: ties, repeated rows
    and extra columns stay; a column of that name is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t or "") for part in sliced([texts]) for t in part.to_pylist()], pa.float64())

    return docs.withColumn(name, scored(F.col(text)))


def query(spark, sf_dir):
    """Every document's score, whether it was held out, and the predicted label."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score(docs, fit(docs, labels)).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
