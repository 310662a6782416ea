"""Operator 5 against brute force, and components."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from lexiforge.llm import ngram_jaccard
from lexiforge.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n=4):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=4, percent=85):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows]
    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    for k, (i, s) in enumerate(sets):
        for m in {m for x in s for m in by[x] if m < k}:
            j, t = sets[m]
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets)


def family(seed, size, length, edits):
    """Copies of a text with words changed, taken out and put in."""
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [f"n{r.randrange(10**6)}"] * r.randrange(2)
        out.append(" ".join(w))
    return out


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()))


def test_families_of_all_sizes_equal_brute_force(spark, docs):
    texts = [t for k, length in enumerate([3, 5, 9, 14, 30, 60, 110, 200, 500, 1500]) for t in family(k, 12, length, 2 + length // 12)]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    assert got(ngram_jaccard.join(docs(rows))) == brute(rows)
    assert got(ngram_jaccard.join(docs(rows), words=5, percent=80)) == brute(rows, 5, 80)


def test_a_group_of_several_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 7)
    rows = list(enumerate(family(5, 60, 150, 9)))
    assert got(ngram_jaccard.join(docs(rows))) == brute(rows)


def test_edges(spark, docs):
    long = "a b c d e f " * 5000
    rows = [(5, None), (6, ""), (7, " \t"), (8, "One two"), (3, "one  two"), (9, "one two three"), (4, long), (1, long + "x"), (2, "É é"), (10, "é é")]
    assert got(ngram_jaccard.join(docs(rows))) == brute(rows)
    again = got(ngram_jaccard.join(docs([*rows, (8, "One two"), (3, "one  two")])))
    assert len(again) == len(rows) + 2 and again.count((8, 1, 3)) == 2
    nulls = ngram_jaccard.join(docs([(None, "a b c d e"), (1, "a b c d e"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in nulls) == [(0, 0, 0), (0, 2, 0), (1, 2, 1)]
    assert ngram_jaccard.join(docs([])).count() == 0


def test_one_of_each_group_stays(spark, docs):
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(4, a), (2, a + " end"), (9, "other text of six words here"), (9, "other text of six words here"), (7, None), (8, None), (None, a)]
    clash = docs(rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "component_id")
    kept = ngram_jaccard.first_of_each(clash)
    assert kept.columns == clash.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 7, 8, 9]
    assert ngram_jaccard.first_of_each(docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(ngram_jaccard.query(spark, d)) == brute(rows)


def test_cells_bound_the_difference():
    import numpy as np

    from lexiforge.llm import jaccard_core as core

    r = np.random.default_rng(3)
    for k in range(60):
        n = int(r.integers(4, 900))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - k * len(a) // 100], r.integers(0, 2**63, k * len(a) // 120).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 80 * (len(a) + len(b) - both)
        counts = np.stack([np.frombuffer(core.cells(x), np.uint8) for x in (a, b)])
        found = core.plausible(np.array([len(a), len(b)]), counts, 80)
        assert found.all() or not linked


def test_signatures_travel_packed(spark, docs):
    texts = docs(list(enumerate(family(2, 50, 300, 20)))).selectExpr("doc_id AS key", "text").coalesce(1)
    rows = ngram_jaccard.signature_rows(texts, 4, 85, 4)
    found = {r.kind: (r["count"], r.n) for r in rows.groupBy("kind").agg({"*": "count", "keys": "max"}).join(rows.groupBy("kind").agg({"part": "max"}).withColumnRenamed("max(part)", "n"), "kind").withColumnRenamed("count(1)", "count").collect()}
    # before: a row for each of some 10,000 signatures
    assert found[ngram_jaccard.SIGNATURE] == (4, 3) and found[ngram_jaccard.FIRST] == (4, 3)


def test_wide_groups_meet_in_tiles_of_what_may_link(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    from lexiforge.llm import jaccard_core as core

    monkeypatch.setattr(ngram_jaccard, "BLOCK", 7)
    texts = [t for k in range(40) for t in family(k, 1, 120, 0)]
    texts[30] = texts[3] + " end"
    s, sizes = core.shingles(texts, 4)
    counted = spark.createDataFrame([(k, int(n), c.tobytes()) for k, (n, c) in enumerate(zip(sizes, core.cell_counts(s, sizes), strict=True))], "key long, size long, cells binary")
    wide = counted.select(F.lit(0).cast("long").alias("centre"), "key", F.lit(6).cast("long").alias("blocks"), (F.col("key") % 6 + F.when(F.col("key") == 30, 1).otherwise(0)).alias("block"))
    tiles = ngram_jaccard.across_blocks(wide, counted, spark.createDataFrame([], "id long, component long"), 85).collect()
    # before: 39 sets in each of the five other blocks
    assert {r.key for r in tiles} == {3, 30} and len(tiles) <= 4


def test_groups_that_go_on_in_the_next_batch(spark):
    import pyarrow as pa

    from lexiforge.llm.common import by_group

    rows = [(g % 5, g // 5 % 2, i) for g in range(10) for i in range([1, 2, 30, 7, 3][g % 5])]
    table = spark.createDataFrame(rows, "a long, b long, x long").repartition(2)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        run = lambda t: pa.table({"a": t.column("a").slice(0, 1), "b": t.column("b").slice(0, 1), "n": pa.array([len(t)]), "s": pa.array([sum(t.column("x").to_pylist())])})
        got = sorted(map(tuple, by_group(table, ["a", "b"], run, "a long, b long, n long, s long").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == sorted((a, b, n, n * (n - 1) // 2) for a in range(5) for b in range(2) for n in [[1, 2, 30, 7, 3][a]])
