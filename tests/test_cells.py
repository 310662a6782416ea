"""Dense search in cells against all cosines."""

from __future__ import annotations

import numpy as np
import pytest

from lexiforge.operators import cells

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, queries, k):
    sound = [(i, np.array(v, float)) for i, v in rows if v is not None and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = set()
    for i, q in sound:
        if i not in queries:
            continue
        scores = [(-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6) + 0.0, j) for j, v in sound if j != i and len(v) == len(q)]
        out |= {(i, j, -s + 0.0, n) for n, (s, j) in enumerate(sorted(scores)[:k], 1)}
    return out


def clustered(seed, n, groups, width=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, width)) * 5
    return [(i, v.tolist()) for i, v in enumerate(centres[r.integers(0, groups, n)] + r.normal(size=(n, width)) * 0.4)]


@pytest.mark.parametrize("sample", [8192, 500])
def test_cells_are_skipped_and_nothing_is_lost(spark, monkeypatch, sample):
    monkeypatch.setattr(cells, "SAMPLE", sample)
    rows = clustered(1, 3000, 40)
    frame = spark.createDataFrame(rows, SCHEMA)
    looked = []
    got = cells.search(frame, frame.filter("vec_id % 20 = 0"), k=7, looked=looked)
    assert {(r.query_id, r.vec_id, r.score, r["rank"]) for r in got.collect()} == plain(rows, set(range(0, 3000, 20)), 7)
    pairs, all_pairs = map(sum, zip(*looked, strict=True))
    assert pairs < 0.35 * all_pairs, looked


def test_without_clusters_every_cell_is_looked_into(spark, monkeypatch):
    monkeypatch.setattr(cells, "ROUND", 10)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(2).normal(size=(800, 16)))]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in cells.search(frame, frame.filter("vec_id < 30"), k=5).select("query_id", "vec_id", "score", "rank").collect()}
    assert got == plain(rows, set(range(30)), 5)


def test_odd_vectors_and_ties(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [1.0, 1.0, 1.0]), (8, [0.0, 1.0]), (9, [float("inf"), 0.0])]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in cells.search(frame, frame, k=2).select("query_id", "vec_id", "score", "rank").collect()}
    assert got == plain(rows, set(range(10)), 2)
    assert (1, 2, 1.0, 1) in got and (1, 3, 1.0, 2) in got and not any(g[0] in (4, 5, 6, 7, 9) for g in got)
    assert cells.search(frame.limit(0), frame, k=2).count() == cells.search(frame, frame.limit(0), k=2).count() == 0
