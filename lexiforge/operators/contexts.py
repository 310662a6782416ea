"""Contexts for a query: candidates without copies, within a budget, merged into source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import tables


def usable(content: Column, quality: Column) -> Column:
    """The first reason why a chunk isn't used, or null."""
    letters = F.regexp_count(content, F.lit(r"\p{L}"))
    return (
        F.when(F.trim(content) == "", "empty")
        .when(F.regexp(F.lower(content), F.lit("<!-- image")), "image_placeholder")
        .when(quality == "layout_unreliable", "layout_unreliable")
        .when(letters < 3, "low_information")
    )


def budgeted(candidates: DataFrame, query: str, order: list[str], tokens: str, most_chunks: int, most_tokens: int) -> DataFrame:
    """Candidates of each query in order, skipping each that would break the budget, up to ``most_chunks``.

    The choice depends on what was taken before, so that it is a fold over a query's candidates, of which
    there are as many as the searches return.
    """
    item = F.struct(*[F.col(c) for c in order], F.col(tokens).cast("long").alias("__n"), F.struct("*").alias("__row"))
    listed = candidates.groupBy(query).agg(F.sort_array(F.collect_list(item)).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("at"))

    def step(s, x):
        fits = (s["used"] + x["__n"] <= most_tokens) & (F.size(s["taken"]) < most_chunks)
        return F.struct(
            F.when(fits, s["used"] + x["__n"]).otherwise(s["used"]).alias("used"),
            F.when(fits, F.concat(s["taken"], F.array(s["at"]))).otherwise(s["taken"]).alias("taken"),
            (s["at"] + 1).alias("at"),
        )

    chosen = listed.select("c", F.aggregate("c", start, step, lambda s: s["taken"]).alias("taken"))
    rows = chosen.select("c", F.posexplode("taken").alias("place", "at")).select("place", F.element_at("c", F.col("at") + 1)["__row"].alias("r"))
    return rows.select("r.*", "place")


def first_texts(candidates: DataFrame, query: str, order: list[str], content: str) -> DataFrame:
    """Candidates whose normalised content no earlier one of the query has."""
    key = F.concat_ws("\u001f", F.col(query).cast("string"), T.normalized(F.col(content)))
    return tables.first_of_key(candidates, key, order)


def blocks(chosen: DataFrame, query: str, document: str, heading: str, place: str, content: str) -> DataFrame:
    """(query, block, document, heading, content): runs of chosen chunks of one document and heading, joined by an empty line."""
    w = Window.partitionBy(query).orderBy(place)
    same = (F.lag(document).over(w) == F.col(document)) & F.lag(heading).over(w).eqNullSafe(F.col(heading))
    rows = tables.islands(chosen, query, [place], same)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(place, content))), lambda x: x[content])
    return rows.groupBy(query, F.col("island").alias("block"), document, heading).agg(F.array_join(parts, "\n\n").alias("content"))


def neighbours(candidates: DataFrame, chunks: DataFrame, document: str, index: str, heading: str) -> DataFrame:
    """For each candidate the chunk before or after it, the earlier first, if it has the same heading."""
    near = chunks.select(F.col(document).alias("__d"), F.col(index).alias("__i"), F.col(heading).alias("__h"), F.struct("*").alias("neighbour"))
    joined = candidates.withColumn("__at", F.explode(F.array(F.col(index) - 1, F.col(index) + 1)))
    pairs = joined.join(near, (F.col(document) == F.col("__d")) & (F.col("__at") == F.col("__i")) & F.col(heading).eqNullSafe(F.col("__h")))
    w = Window.partitionBy(document, index).orderBy("__i")
    return pairs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__d", "__i", "__h", "__at", "__n")
