"""Boxes on pages; checks of generated objects."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lexiforge.operators import checks, layout

BOX = "struct<l:double,t:double,r:double,b:double>"


def test_boxes_turn_to_the_top_left(spark):
    row = spark.range(1).select(layout.canonical(*map(F.lit, (9.0, 90.0, 1.0, 70.0)), F.lit(True), F.lit(100.0)).alias("x")).first().x
    assert tuple(row) == (1.0, 10.0, 9.0, 30.0, 160.0)


def test_lines_measure_from_their_first_box(spark):
    rows = [(1, 0.0, 5.0, "b"), (1, 10.0, 0.0, "a"), (1, 20.0, 0.0, "c"), (2, 0.0, 0.0, "نص"), (2, 1.0, 9.0, "عربي")]
    got = layout.visual_lines(spark.createDataFrame(rows, "page int, top double, left double, x string"), "page", "top", "left", "x")
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "عربي نص")]


def test_captions_are_the_nearest_text(spark):
    images = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 10.0)), (2, 2, (0.0, 0.0, 1.0, 1.0))], f"image_id int, page int, box {BOX}")
    texts = spark.createDataFrame([(1, (0.0, 12.0, 9.0, 15.0), "below"), (1, (30.0, 0.0, 40.0, 5.0), "beside"), (2, (0.0, 500.0, 1.0, 501.0), "far")], f"page int, box {BOX}, text string")
    got = {r.image_id: r.caption for r in layout.captions(images, texts, "page").collect()}
    assert got == {1: "below", 2: None}


def test_sections_start_at_headings_and_numbers(spark):
    rows = [(1, 0, "text", "intro"), (1, 1, "title", "A"), (1, 2, "text", "x"), (1, 3, "text", "2) y")]
    got = layout.sections(spark.createDataFrame(rows, "page int, i int, label string, x string"), "page", "i", "label", "x").orderBy("i").collect()
    assert [r.section for r in got] == [0, 1, 1, 2]


def test_objects_in_noisy_text(spark):
    text = 'Sure: {"a": {"b": 1}} and {bad} then {"title": "t", "steps": []}'
    rows = spark.createDataFrame([(1, text), (2, None), (3, "none {")], "id int, x string")
    found = checks.json_objects(rows, "id", "x")
    assert [json.loads(r.object) for r in found.orderBy("place").collect()] == [{"a": {"b": 1}}, {"b": 1}, {"title": "t", "steps": []}]
    best = checks.best_object(found, "id", ["title"], {"steps": 2, "a": 1}).collect()
    assert [(r.id, json.loads(r.object)["title"]) for r in best] == [(1, "t")]


def test_references_and_plans(spark):
    items = spark.createDataFrame([(1, ["kb:1", "kb:9"]), (2, ["kb:2"])], "id int, refs array<string>")
    got = checks.unknown_references(items, checks.allowed_table(spark, "kb", 3), "id", "refs").collect()
    assert [tuple(r) for r in got] == [(1, "kb:9")]
    step = "array<struct<phase:string,minutes:int,materials:string>>"
    plans = spark.createDataFrame([(1, 30, [("Start", 10, "book"), ("Work", 20, "cards")]), (2, 30, [("A", 10, " "), ("a", 0, "x")]), (3, 5, None)], f"id int, minutes int, steps {step}")
    got = {r.id: r.faults for r in checks.plan_faults(plans).collect()}
    assert got == {1: [], 2: ["duration_mismatch", "empty_step", "repeated_phase", "no_materials"], 3: ["no_steps"]}
    parts = spark.createDataFrame([(1, "s1", "x"), (1, "s2", "x"), (1, "s2", "y")], "id int, s string, g string")
    assert [(r.g, r.sections) for r in checks.repeated_across(parts, "id", "s", "g").collect()] == [("x", 2)]


def test_images_belong_to_their_only_match(spark):
    images = spark.createDataFrame([(1, 1, "the red house"), (2, 1, "nothing alike"), (3, 2, "x"), (4, 1, "a red barn door")], "image_id int, page int, nearby_text string")
    chunks = spark.createDataFrame([(10, 1, "A red house stands"), (11, 1, "a red door, a barn"), (12, 2, "only one")], "chunk_id int, page int, text string")
    got = {r.image_id: r.chunk_id for r in layout.associated(images, chunks).collect()}
    assert got == {1: 10, 2: None, 3: 12, 4: 11}


def test_captions_of_equal_boxes_are_found_once(spark):
    """Many images and texts with few different boxes: each image has the least of the nearest texts, and pairs don't multiply."""
    box = "named_struct('l', CAST(id % 3 * 40 AS DOUBLE), 't', 0D, 'r', CAST(id % 3 * 40 + 30 AS DOUBLE), 'b', 30D)"
    images = spark.range(30_000).selectExpr("id AS image_id", "id % 2 AS page", f"{box} AS box")
    texts = spark.range(30_000).selectExpr("id % 2 AS page", f"{box} AS box", "concat('t', id) AS text")
    got = layout.captions(images, texts, "page").groupBy("page", "box", "caption").count().collect()
    least = {(i % 2, i % 3 * 40): min(f"t{k}" for k in range(i, 30_000, 6)) for i in range(6)}
    assert {(r.page, r.box.l): r.caption for r in got} == least
    assert sum(r["count"] for r in got) == 30_000
