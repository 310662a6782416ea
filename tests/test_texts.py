"""What of a text goes to a Python worker, and that its result is the same as if all of it went."""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import composing
from lexiforge.operators import descriptors as D
from lexiforge.operators import impacts as I

TEXTS = ["plain", "déjà vu", "Ἀθῆναι", "été", "Ω ohm", "각 각", "نص عربي", "نَصّ", "𝒜 \U0001d15e", "ſtraße ŒUVRE", "日本語 が", "", None, "KK", "á̧"]


def test_settled_characters_are_composed_anywhere():
    settled = re.compile(f"[{T.SETTLED}]")
    seconds = {int(x.split()[1], 16) for c in range(sys.maxunicode + 1) if (x := unicodedata.decomposition(chr(c))) and x[0] != "<" and " " in x} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for c in filter(settled.match, map(chr, range(0x10000))):
        assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and ord(c) not in seconds, hex(ord(c))


def test_composed(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, t string")
    for r in rows.select("t", T.composed(F.col("t")).alias("c"), T.uncomposed(F.col("t")).alias("goes")).collect():
        assert r.c == (None if r.t is None else unicodedata.normalize("NFC", r.t))
        assert r.goes is None or r.goes == r.t
    assert {r.t for r in rows.filter(T.uncomposed(F.col("t")).isNull()).collect()} >= {"plain", "déjà vu", "نص عربي", "ſtraße ŒUVRE", "", None}


def test_distinct_descriptors_in_one_pass_equal_those_of_the_star(spark):
    rows = [(1, "A1, Lecture = Peut lire. B1, Lecture = Peut écrire. A1, lecture = peut LIRE."), (2, "A1, Lecture = Peut lire."), (3, "A1, 12 = Peut lire."), (0, "B1, Lecture = pas de descripteur disponible ; voir A2. B1, Lecture = Peut écrire.")]
    records = D.parsed(spark.createDataFrame(rows, "chunk_id long, text string"))
    star = D.star(records)
    held = star["sources"].groupBy("descriptor_hash").agg(F.count("*").alias("sources"), F.min("chunk_id").alias("first_source"))
    want = star["descriptors"].join(held, "descriptor_hash").select("descriptor_hash", "level", "scale_key", "sources", "first_source")
    got = D.summary(records)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    # the texts are parsed once
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def plain_folded(t):
    bare = "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn").casefold()
    return re.sub(r"\s+", " ", bare).strip()


def test_head_is_enough_for_the_beginning_of_the_folded_text(spark):
    texts = [*(t for t in TEXTS if t), "a\u0301" * 400, " \n" * 500 + "é" * 300, "ß ŉ ǰ " * 200, "..." * 300, "x" + "\u0301" * 5000 + "y" * 400, "نَصّ " * 300, "각각 " * 200]
    n = 20
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.head(F.col("t"), n).alias("h"), F.substring(T.folded(T.head(F.col("t"), n)), 1, n).alias("f"), T.folded(F.col("t")).alias("whole"))
    for r in rows.collect():
        assert r.t.startswith(r.h) and r.f == plain_folded(r.t)[:n] and r.whole == plain_folded(r.t), r.t[:40]
    assert {len(r.h) for r in rows.filter("(t LIKE '각각%' OR t LIKE 'a%') AND length(t) > 20").collect()} <= {29, 39}


def test_terms_are_counted_in_slices(spark, monkeypatch):
    lists = pa.array([["a"] * 5, [], ["b", "c"], ["a", "d"], ["e"] * 9, []], pa.list_(pa.string()))
    assert I.slices(lists, 4) == [(0, 1), (1, 3), (4, 1), (5, 1)]
    assert I.slices(lists.slice(0, 0), 4) == [(0, 0)]
    assert I.slices(lists.slice(1), 4) == [(0, 3), (3, 1), (4, 1)]
    docs = spark.createDataFrame([(k, "a b a " * (k % 4) + f"c{k % 3}") for k in range(40)], "k long, t string").coalesce(1)
    counts = lambda among: sorted((r.k, sorted((x.term, x.n) for x in r.c)) for r in docs.select("k", I.counted(T.terms(F.col("t")), among).alias("c")).collect())
    want = [counts(None), counts(["a", "c1", "z"])]
    monkeypatch.setattr(I, "SLICE", 5)
    assert [counts(None), counts(["a", "c1", "z"])] == want


def test_requests_are_looked_at_singly():
    batch = pa.RecordBatch.from_pydict({"request": [1, 2, 3]})
    assert [b.to_pydict() for b in composing.singly(iter([batch, batch.slice(0, 0)]))] == [{"request": [k]} for k in (1, 2, 3)]
