"""Lexical search in order of impact against scores of all documents."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from lexiforge.operators import impacts as I
from lexiforge.operators import retrieval as R


def corpus(seed, n):
    r = random.Random(seed)
    common, rare = [f"c{k}" for k in range(8)], [f"r{k}" for k in range(200)]
    return [(i, " ".join([r.choice(common) for _ in range(r.randrange(1, 50))] + [w for w in rare if r.random() < 0.01 for _ in range(r.randrange(1, 9))])) for i in range(n)]


def plain(docs, items, k):
    bags = {i: Counter((t or "").split()) for i, t in docs}
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for item, text in items:
        scores = defaultdict(float)
        for w, times in Counter(text.split()).items():
            if w not in df:
                continue
            idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
            for i, b in bags.items():
                if b[w]:
                    scores[i] += (1 + math.log(b[w])) * (1 + math.log(times)) * idf
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out |= {(item, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [16, 1024])
def test_search_equals_scoring_all(spark, monkeypatch, block):
    monkeypatch.setattr(I, "BLOCK", block)
    docs = corpus(1, 1500) + [(9000, None), (9001, ""), (9002, "c1"), (9003, "c1")]
    items = [(1, "r1 r2 c1 c2 c3"), (2, "c1 c1 c2"), (3, "r5"), (4, "nowhere"), (5, "r7 r8 r9 r9 c0 c1 c2 c3 c4 c5"), (6, "")]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), R.postings(spark.createDataFrame(items, "item_id long, text string"), "item_id")
    read = []
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in I.search(I.index(frame, asked), asked, "item_id", 10, read).collect()}
    want = plain(docs, items, 10)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert read[0][0] < 0.6 * read[0][1], read


def test_what_is_left_out_cannot_reach_the_threshold(spark):
    docs = corpus(2, 800)
    items = [(k, f"r{k} r{k + 1} c1 c2 c3 c4 c5") for k in range(30)]
    asked = R.postings(spark.createDataFrame(items, "item_id long, text string"), "item_id")
    index = I.index(spark.createDataFrame(docs, "doc_id long, text string"), asked)
    weights = asked.join(index.frequencies(), "term").selectExpr("item_id", "term", "tf * idf AS q")
    least = I.thresholds(index, weights, "item_id", 5, I.tf)
    kth = {item: s for (item, n), (_, s) in plain(docs, items, 5).items() if n == 5}
    found = {r.item_id: r.least for r in least.collect()}
    assert found and all(found[i] <= kth[i] + 2e-6 for i in found)
    left = I.unread(index, weights, least, "item_id", I.tf).groupBy("item_id").max("bound").collect()
    assert left and all(r["max(bound)"] < found[r.item_id] for r in left)


def test_overlap_and_many_terms(spark, monkeypatch):
    docs, items = corpus(3, 400), [(1, "c1 c2 c3 r1 r2 r3 r4"), (2, "c0 r9")]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), R.postings(spark.createDataFrame(items, "item_id long, text string"), "item_id")
    want = {(i, n): x for i, t in items for n, x in enumerate(sorted((-len(set(t.split()) & set(d.split())), k) for k, d in docs)[:5], 1)}
    for most in (500_000, 1):
        monkeypatch.setattr(I, "BROADCAST_ROWS", most)
        got = {(r.item_id, r["rank"]): (-r.score, r.doc_id) for r in I.overlap(I.index(frame, asked), asked, "item_id", 5).collect()}
        assert got == want


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = R.postings(spark.createDataFrame([(1, "a b")], "item_id long, text string"), "item_id")
    assert I.search(I.index(none, asked), asked, "item_id").count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert I.search(I.index(some, asked.limit(0)), asked.limit(0), "item_id").count() == 0
