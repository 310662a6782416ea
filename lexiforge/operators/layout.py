"""Boxes on pages: canonical form, visual lines, captions, sections."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def canonical(left: Column, top: Column, right: Column, bottom: Column, from_bottom: Column, height: Column) -> Column:
    """A box with its origin at the top left and sides in order, with its area."""
    t = F.when(from_bottom, height - F.greatest(top, bottom)).otherwise(F.least(top, bottom))
    b = F.when(from_bottom, height - F.least(top, bottom)).otherwise(F.greatest(top, bottom))
    l, r = F.least(left, right), F.greatest(left, right)
    return F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"), ((r - l) * (b - t)).alias("area"))


def visual_lines(boxes: DataFrame, page: str, top: str, left: str, text: str, gap: float = 12.0) -> DataFrame:
    """(page, line, text): boxes from top to bottom, a new line where one lies more than ``gap`` below the line's first.

    Within a line boxes go from left to right, from right to left where Arabic letters prevail. The distance is
    to the line's first box, so that the lines are a fold over one page's boxes.
    """
    listed = boxes.groupBy(page).agg(F.sort_array(F.collect_list(F.struct(F.col(top).cast("double").alias("t"), F.col(left).cast("double").alias("l"), F.col(text).alias("x")))).alias("boxes"))

    def run(batches):
        for batch in batches:
            out = [(p, n, line) for p, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, line in enumerate(lines_of(b, gap))]
            kinds = (batch.column(0).type, pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True)], names=[page, "line", "text"])

    return listed.mapInArrow(run, f"{page} {boxes.schema[page].dataType.simpleString()}, line long, text string")


def lines_of(boxes: list[dict], gap: float) -> list[str]:
    """Texts of the lines of one page's boxes, which come from top to bottom."""
    lines: list[list[tuple]] = []
    head = 0.0
    for b in boxes:
        if not lines or b["t"] - head > gap:
            lines.append([])
            head = b["t"]
        lines[-1].append((b["l"], b["x"] or ""))
    out = []
    for line in lines:
        whole = " ".join(x for _, x in sorted(line))
        arabic, latin = (len(re.findall(p, whole)) for p in ("[؀-ۿ]", "[A-Za-zÀ-ɏ]"))
        out.append(" ".join(x for _, x in sorted(line, reverse=True)) if arabic > latin else whole)
    return out


#: What a unit of vertical and of horizontal distance costs.
DOWN, ACROSS = 2.0, 0.35


def captions(images: DataFrame, texts: DataFrame, page: str, most: float = 120.0) -> DataFrame:
    """Each image (image_id, page, box) with the text (page, box, text) next to it: the least 2 dy + 0.35 dx, up to ``most``.

    A page is a grid whose cells are as large as the reach of an image; an image meets only the texts in the
    cells that its reach touches, so that pairs grow with the boxes and not with their square. Equal boxes of a
    page are looked at once: of their texts the least counts, and their images have the same caption.
    """
    high, wide = most / DOWN, most / ACROSS

    def in_cells(rows: DataFrame, box: str, dy: float, dx: float) -> DataFrame:
        steps = lambda low, top, size: F.sequence(F.floor(low / size), F.floor(top / size))
        b = F.col(box)
        rows = rows.withColumn("row", F.explode(steps(b["t"] - dy, b["b"] + dy, high)))
        return rows.withColumn("column", F.explode(steps(b["l"] - dx, b["r"] + dx, wide)))

    said = texts.groupBy(page, F.col("box").alias("b")).agg(F.min(F.struct(F.col("text").alias("near_text"))).alias("said"))
    near = in_cells(said.select(page, "b", "said.near_text"), "b", 0.0, 0.0)
    places = images.select(page, "box").distinct()
    pairs = in_cells(places, "box", high, wide).join(near, [page, "row", "column"])
    apart = lambda a, b, c, d: F.greatest(F.lit(0.0), a - d, c - b)
    dy = apart(F.col("box.t"), F.col("box.b"), F.col("b.t"), F.col("b.b"))
    dx = apart(F.col("box.l"), F.col("box.r"), F.col("b.l"), F.col("b.r"))
    best = pairs.withColumn("cost", DOWN * dy + ACROSS * dx).filter(F.col("cost") <= most).groupBy(page, "box").agg(F.min_by("near_text", F.struct("cost", "near_text")).alias("caption"))
    return images.join(best, [page, "box"], "left")


def sections(rows: DataFrame, page: str, place: str, label: str, text: str) -> DataFrame:
    """Numbers the sections of a page: one starts at a heading and at a leading number."""
    start = F.col(label).isin("section_header", "title") | F.regexp(F.col(text), F.lit(r"^\s*\d{1,2}[.)]\s"))
    w = Window.partitionBy(page).orderBy(place)
    return rows.withColumn("section", F.sum(F.when(start, 1).otherwise(0)).over(w))


def associated(images: DataFrame, chunks: DataFrame, page: str = "page", least: int = 2) -> DataFrame:
    """(image_id, chunk_id): each image's only chunk of its page with ``least`` common terms, else the page's only chunk.

    ``images`` has image_id, page and nearby_text, ``chunks`` chunk_id, page and text. Terms are exploded, so
    that images and chunks meet by page and term.
    """
    words = lambda rows, key, body: rows.select(key, page, F.explode(F.array_distinct(F.filter(T.terms(F.col(body)), lambda t: F.char_length(t) >= 2))).alias("term"))
    shared = words(images, "image_id", "nearby_text").join(words(chunks, "chunk_id", "text"), [page, "term"]).groupBy("image_id", "chunk_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    matched = shared.groupBy("image_id").agg(F.when(F.count("*") == 1, F.min("chunk_id")).alias("matched"))
    alone = chunks.groupBy(page).agg(F.when(F.count("*") == 1, F.min("chunk_id")).alias("alone"))
    return images.join(matched, "image_id", "left").join(alone, page, "left").select("image_id", F.coalesce("matched", "alone").alias("chunk_id"))
