"""Relational operators: pages, facets, latest rows, set comparisons, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page in a total order, with the number of rows and of pages."""
    total = rows.agg(F.count("*").alias("total"))
    cut = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return cut.join(F.broadcast(total), how="cross").withColumn("pages", F.ceil(F.col("total") / size).cast("long"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n): how often each value comes, over several columns at once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def first_of_key(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key in order; rows with an empty key all stay."""
    keyed = rows.withColumn("__key", key)
    w = Window.partitionBy("__key").orderBy(*order)
    return keyed.withColumn("__place", F.row_number().over(w)).filter("__place = 1 OR __key = ''").drop("__place", "__key")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table after the changes: theirs wins, rows without a change stay."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, state): both, left_only, right_only."""
    a, b = (x.select(key).distinct().withColumn(n, F.lit(True)) for x, n in ((left, "__l"), (right, "__r")))
    state = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def adjacent(rows: DataFrame, group: str, place: str, distance: int) -> DataFrame:
    """Pairs of rows of a group whose places differ by at most ``distance``, by window rather than by join."""
    w = Window.partitionBy(group).orderBy(place).rangeBetween(-distance, distance)
    return rows.withColumn("near", F.collect_list(place).over(w))


def islands(rows: DataFrame, group: str, order: list[str], same: Column) -> DataFrame:
    """Numbers runs of rows for which ``same`` holds against the row before."""
    w = Window.partitionBy(group).orderBy(*order)
    start = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("__start", start).withColumn("island", F.sum("__start").over(w)).drop("__start")


def owned(table: DataFrame, changes: DataFrame, key: str, owner: str) -> DataFrame:
    """The table after the changes that its rows' own owners make; a foreign change is as one of a row that isn't there."""
    return upsert(table, changes.join(table.select(key, owner), [key, owner], "left_semi").select(*table.columns), [key])


def attached(points: DataFrame, vectors: DataFrame, key: str, name: str) -> DataFrame:
    """``points`` with a vector for those that are there, ``name``; (key, missing) vectors without a point make none."""
    return points.join(vectors.select(key, name), key, "left")


def appended(turns: DataFrame, exchanges: DataFrame, key: str, turn: str) -> DataFrame:
    """``turns`` (key, turn, role, text) with each exchange (key, question, answer) after its conversation's last turn."""
    last = turns.groupBy(key).agg(F.max(turn).alias("__last"))
    both = F.array(F.struct(F.lit(1).alias("n"), F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit(2).alias("n"), F.lit("assistant").alias("role"), F.col("answer").alias("text")))
    new = exchanges.join(last, key, "left").select(key, F.coalesce("__last", F.lit(0)).alias("__last"), F.inline(both))
    return turns.select(key, turn, "role", "text").unionByName(new.select(key, (F.col("__last") + F.col("n")).alias(turn), "role", "text"))
