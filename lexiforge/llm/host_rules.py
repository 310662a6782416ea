"""Operator 12: quality rules of documents, judged by host.

Each text is measured where it lies: its words, symbols, repeated lines and repeated three-word windows. Which
rules it fails is counted by host, with partial sums before the shuffle. A host of few documents says little
by itself: per rule, a beta prior is fitted to all hosts by moments, and a host's rate is shrunk to it,
(failures + alpha) / (documents + alpha + beta). The verdict of a host comes back to its documents:

- a host is barred where the shrunk rate of documents that fail any rule is over BARRED: none of its documents stays;
- a host is strict on a rule where its shrunk rate is over STRICT and over TIMES the rate of all documents:
  its documents that fail this rule go;
- elsewhere a document goes by the base rules only.

Hosts with at least 1/LARGE of all documents are at most LARGE rows, which are broadcast, so that no task gets
a hot host's documents; the others are joined by a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, checkpoint

#: Rules of a document on its measures, as SQL; the first two are the base.
RULES = {
    "few_words": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 12 * n_words",
}
BASE = ("few_words", "repeats")
ANY = "any"
BARRED, STRICT, TIMES = 0.5, 0.2, 2.0
#: The prior counts as so many documents at least and at most.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1000.0
LARGE = 1_000
#: Bytes of texts that are measured at once; a longer text stands alone.
BYTES = 4 << 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def codes(values: pa.Array) -> np.ndarray:
    """Numbers of equal values, from 0."""
    return values.dictionary_encode().indices.to_numpy().astype(np.int64)


def pieces(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The strings of all lists that aren't empty, and the number of each one's list."""
    flat, of = lists.flatten(), np.asarray(pc.list_parent_indices(lists), np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), of[np.asarray(full)]


def repeated(words: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which words lie in a three-word window that comes twice or more in their text."""
    inside = np.zeros(len(words), bool)
    if len(words) < 3:
        return inside
    size = int(words.max()) + 1
    pairs = codes(pa.array(words[:-1] * size + words[1:]))
    windows = codes(pa.array(pairs[:-1] * size + words[2:]))
    starts = np.flatnonzero(of[:-2] == of[2:])
    own = codes(pa.array(of[starts] * (int(windows.max()) + 1) + windows[starts]))
    again = starts[np.bincount(own)[own] > 1] if len(own) else starts
    for k in range(3):
        inside[again + k] = True
    return inside


def measured(texts: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text; words lie between the six ASCII blanks, lines between line feeds."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    words, of = pieces(pc.ascii_split_whitespace(texts))
    lines, line_of = pieces(pc.split_pattern(texts, "\n"))
    full = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0))
    lines, line_of = lines.filter(pa.array(full)), line_of[full]
    line_codes = codes(lines)
    distinct = codes(pa.array(line_of * (int(line_codes.max(initial=0)) + 1) + line_codes))
    first = np.unique(distinct, return_index=True)[1]
    chars = np.asarray(pc.utf8_length(words), np.int64)
    ends = np.concatenate([[0], np.cumsum(chars)])
    n_words, n_lines = np.bincount(of, minlength=n), np.bincount(line_of, minlength=n)
    cuts = np.concatenate([[0], np.cumsum(n_words)])
    return [
        n_words,
        ends[cuts[1:]] - ends[cuts[:-1]],
        np.asarray(pc.count_substring_regex(texts, "[#*$%&|<>]"), np.int64),
        n_lines,
        n_lines - np.bincount(line_of[first], minlength=n),
        np.bincount(of[repeated(codes(words), of)], minlength=n),
    ]


def measures(text: Column) -> Column:
    """A struct of MEASURES, longs, of each whole text; a null text has none of anything."""
    kind = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        parts = [measured(texts.slice(a, b - a)) for a, b in by_bytes(texts, BYTES)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], MEASURES)

    return run(text)


def prior(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float, float]]:
    """(alpha, beta, rate of all documents) of each rule, by moments over all hosts.

    The rates of hosts spread more than chance alone would have them by a share rho = 1 / (alpha + beta + 1).
    Sums are decimals, so that they don't depend on an order.
    """
    parts = [F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("decimal(20,0)") * F.col("n")).cast("double").alias("squares")]
    parts += [F.sum(r).alias(f"k_{r}") for r in rules]
    parts += [F.sum((F.col(r).cast("double") * F.col(r) / F.col("n")).cast("decimal(38,3)")).cast("double").alias(f"q_{r}") for r in rules]
    t = hosts.agg(*parts).first()
    out = {}
    for r in rules:
        n = t.n or 0
        rate = t[f"k_{r}"] / n if n else 0.0
        size = MOST_PRIOR
        free = n - t.squares / n - (t.hosts - 1) if n else 0.0
        if 0 < rate < 1 and free > 0:
            spread = t[f"q_{r}"] - n * rate * rate
            rho = (spread / (rate * (1 - rate)) - (t.hosts - 1)) / free
            size = min(max(1 / rho - 1, LEAST_PRIOR), MOST_PRIOR) if rho > 0 else MOST_PRIOR
        out[r] = rate * size, (1 - rate) * size, rate
    return out


def verdicts(hosts: DataFrame, rules: list[str]) -> DataFrame:
    """(host, n, barred, strict): ``strict`` holds the rules on which a host is strict."""
    known = prior(hosts, [*rules, ANY])
    shrunk = {r: (F.col(r) + a) / (F.col("n") + (a + b)) for r, (a, b, _) in known.items()}
    strict = [F.when((shrunk[r] > STRICT) & (shrunk[r] > TIMES * known[r][2]), F.lit(r)) for r in rules]
    return hosts.select("host", "n", (shrunk[ANY] > BARRED).alias("barred"), F.array_compact(F.array(*strict)).alias("strict"))


def measure(docs: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """``docs`` with a column ``name``: a struct of MEASURES of each whole text; null and empty texts have none of anything. A column of that name is replaced."""
    return docs.withColumn(name, measures(F.col(text)))


def judge(docs: DataFrame, host: str = "source", measured: str = "measures", rules: dict[str, str] = RULES, base=BASE, name: str = "verdict") -> DataFrame:
    """``docs``, measured, with a column ``name``: a struct of ``failed`` (names of rules), ``base_failed``, ``barred``, ``strict`` (names of rules) and ``kept``.

    Null and empty texts have no words and fail the base. Documents without a host (null) have no verdict but
    that of the base rules, and count for no prior. Repeated rows count as often as they come and share their
    fate. An empty table gives an empty one. Other columns stay, whatever their names; one of that name is
    replaced. All columns are written once, so that texts that aren't needed later are better dropped before.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != name]).alias("row"), F.col(host).cast("string").alias("host"))
    of_row = re.compile(rf"\b({'|'.join(MEASURES)})\b")
    failed = F.array_compact(F.array(*[F.when(F.expr(of_row.sub(rf"row.`{measured}`.\1", sql)), F.lit(r)) for r, sql in rules.items()]))
    rows = checkpoint(rows.withColumn("failed", failed))
    fails = {r: F.array_contains("failed", r) for r in rules} | {ANY: F.size("failed") > 0}
    hosts = checkpoint(rows.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(c).alias(r) for r, c in fails.items()]))
    total = hosts.agg(F.sum("n")).first()[0] or 0
    said = verdicts(hosts, list(rules)).withColumn("large", F.col("n") * LARGE >= total)
    told = F.struct("barred", "strict").alias("told")
    hot = said.filter("large").select("host", told)
    cold = said.filter("NOT large AND (barred OR size(strict) > 0)").select("host", told)
    met = rows.join(F.broadcast(hot), "host", "left")
    there, others = met.filter("host IS NULL OR told IS NOT NULL"), met.filter("host IS NOT NULL AND told IS NULL").drop("told").join(cold, "host", "left")
    met = there.unionByName(others)
    barred, strict = F.coalesce("told.barred", F.lit(False)), F.coalesce("told.strict", F.array().cast("array<string>"))
    base_failed = F.arrays_overlap("failed", F.array(*map(F.lit, base)))
    kept = ~base_failed & ~barred & ~F.arrays_overlap("failed", strict)
    verdict = F.struct("failed", base_failed.alias("base_failed"), barred.alias("barred"), strict.alias("strict"), kept.alias("kept"))
    return met.select("row.*", verdict.alias(name))


def query(spark, sf_dir):
    """Per document its measures, whether it fails the base rules, and whether it stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    thin = judge(measure(docs).drop("text")).select("doc_id", "measures.*", "verdict.*")
    return thin.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
