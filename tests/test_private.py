"""Access to named documents, and what a search within them returns."""

from __future__ import annotations

from lexiforge.operators import impacts as I
from lexiforge.operators import private as P
from lexiforge.operators import retrieval as R


def test_access_and_search(spark):
    docs = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, "a", False), (4, "b", True), (5, "a", True)], "doc_id long, owner string, ready boolean")
    asked = [(1, "a", [1, 2, 2, 5]), (2, "a", [1, 4]), (3, "a", [1, 3]), (4, "a", []), (5, "a", None), (6, "b", [4]), (7, "a", [99])]
    allowed = P.access(spark.createDataFrame(asked, "request_id long, owner string, ids array<bigint>"), docs)
    assert {r.request_id: r.reason for r in allowed.collect()} == {1: None, 2: "unavailable", 3: "not_ready", 4: "nothing_selected", 5: "nothing_selected", 6: None, 7: "unavailable"}
    texts = spark.createDataFrame([(1, "red apple"), (2, "blue sky"), (3, "red red"), (4, "red house"), (5, "green sea")], "doc_id long, text string")
    terms = R.postings(spark.createDataFrame([(1, "red sky"), (6, "nothing here")], "request_id long, text string"), "request_id")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0, 1.0]), (5, [0.0, 0.0])], "doc_id long, v array<double>")
    own = spark.createDataFrame([(1, [1.0, 0.1]), (6, [1.0, 0.0])], "request_id long, v array<double>")
    index = I.index(texts, terms)
    got = sorted((r.request_id, r["rank"], r.doc_id, r.mode) for r in P.search(allowed, vectors, terms, own, index, docs).collect())
    assert [g[:3:2] for g in got] == [(1, 1), (1, 2), (6, 4)] and [g[3] for g in got] == ["hybrid", "hybrid", "dense_fallback"]
    # one that has gone since the search isn't returned, and leaves a gap
    later = sorted((r.request_id, r["rank"], r.doc_id) for r in P.search(allowed, vectors, terms, own, index, docs.filter("doc_id <> 1")).collect())
    assert later == [(1, 2, 2), (6, 1, 4)]
