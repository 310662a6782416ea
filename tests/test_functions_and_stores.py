"""Table functions in SQL, the vector store, captions in cells."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import tables
from lexiforge.operators import composing, layout
from lexiforge.plans import chunking
from lexiforge.sources import vectors

DIR = "/root/testdata/sf0.001"


def test_table_functions_keep_columns_and_order(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(q, k, t, "x") for q, ts in ((1, (900, 1000, 800, 50, 30)), (2, (10, None)), (3, (5000,))) for k, t in enumerate(ts)], "q long, k long, tokens long, more string")
    got = spark.sql("SELECT * FROM context_within(TABLE({r}) PARTITION BY (q) ORDER BY (k DESC), 3, 1800)", r=rows)
    assert got.columns == ["q", "k", "tokens", "more", "place"]
    assert sorted((r.q, r.k, r.place) for r in got.collect()) == [(1, 2, 2), (1, 3, 1), (1, 4, 0), (2, 0, 1), (2, 1, 0)]
    with pytest.raises(Exception, match="lacks tokens"):
        spark.sql("SELECT * FROM context_within(TABLE({r}) PARTITION BY (q) ORDER BY (k), 3, 1800)", r=rows.drop("tokens")).collect()
    with pytest.raises(Exception, match="lacks document, page, heading, category, intent"):
        spark.sql("SELECT * FROM composed_context(TABLE({r}) PARTITION BY (q) ORDER BY (k))", r=rows).collect()


def test_composer_in_sql_equals_the_composer(spark):
    made = sorted(map(tuple, chunking.sql_composed(spark, DIR).select("request", "place", "id", "reason").collect()))
    assert made == sorted(map(tuple, composing.composed(chunking.candidates(spark, DIR).drop("content", "tokens"), "request", ["id"]).select("request", "place", "id", "reason").collect()))


@pytest.fixture
def store(spark, tmp_path):
    vectors.register(spark)
    options = {"path": str(tmp_path), "collection": "c"}
    read = lambda: spark.read.format("vector_store").options(**options).load()

    def write(rows, mode="append"):
        frame = rows if hasattr(rows, "write") else spark.createDataFrame(rows, vectors.SCHEMA)
        frame.write.format("vector_store").mode(mode).options(**options).save()

    return read, write, tmp_path / "c"


def points(df):
    return sorted((r.id, tuple(r.vector) if r.vector is not None else None, r.payload) for r in df.collect())


def test_points_are_upserted_and_writes_can_run_twice(store):
    read, write, _ = store
    assert points(read()) == []
    first = [(f"p{k:03}", [float(k), 1.0], f"a{k}") for k in range(50)]
    write(first)
    write(first)
    assert points(read()) == [(i, tuple(v), p) for i, v, p in first]
    write([("p003", [9.0, 9.0], "new"), ("q", None, None)])
    got = {i: (v, p) for i, v, p in points(read())}
    assert len(got) == 51 and got["p003"] == ((9.0, 9.0), "new") and got["q"] == (None, None)
    write([("only", [1.0], "x")], mode="overwrite")
    assert points(read()) == [("only", (1.0,), "x")]


def test_a_failed_write_leaves_no_point(spark, store):
    read, write, folder = store
    write([("a", [1.0], "x")])
    before = vectors.pages_of(str(folder))
    bad = spark.range(200).select(F.when(F.col("id") < 150, F.concat(F.lit("n"), "id")).alias("id"), F.array(F.lit(1.0)).alias("vector"), F.lit("y").alias("payload")).repartition(4)
    with pytest.raises(Exception, match="no id"):
        write(bad)
    assert points(read()) == [("a", (1.0,), "x")] and vectors.pages_of(str(folder)) == before


def test_filters_reach_the_pages(spark, store):
    read, write, folder = store
    for k in range(4):
        write([(f"{k}-{j}", [1.0], "") for j in range(10)])
    assert len(vectors.pages_of(str(folder))) >= 4
    one = vectors.Reader(str(folder))
    assert list(one.pushFilters([vectors.EqualTo(("id",), "2-3")])) == []
    assert len(one.partitions()) == 1
    assert [p[0] for p in points(read().filter("id = '2-3'"))] == ["2-3"]
    assert [p[0] for p in points(read().filter("id IN ('0-1', '3-9', 'zz')"))] == ["0-1", "3-9"]
    assert len(points(read().filter("id >= '1' AND id < '2-5' AND payload = ''"))) == 15
    assert points(read().filter("id > 'zz'")) == []


def test_captions_in_cells_equal_all_pairs(spark):
    r = random.Random(4)
    box = lambda: (lambda left, top: {"l": left, "t": top, "r": left + r.uniform(1, 400), "b": top + r.uniform(1, 90)})(r.uniform(-50, 900), r.uniform(-50, 1200))
    schema = "struct<l: double, t: double, r: double, b: double>"
    images = [(k, k % 5, box()) for k in range(60)] + [(900, 1, None)]
    texts = [(k % 5, box(), f"t{k}") for k in range(150)]
    got = {x.image_id: x.caption for x in layout.captions(spark.createDataFrame(images, f"image_id long, page long, box {schema}"), spark.createDataFrame(texts, f"page long, box {schema}, text string"), "page").collect()}
    want = {}
    for k, page, b in images:
        costs = [(2 * max(0, b["t"] - o["b"], o["t"] - b["b"]) + 0.35 * max(0, b["l"] - o["r"], o["l"] - b["r"]), t) for p, o, t in texts if p == page] if b else []
        want[k] = min(((c, t) for c, t in costs if c <= 120), default=(0, None))[1]
    assert got == want and None in want.values() and sum(v is not None for v in want.values()) > 30
