"""Table functions for SQL: choices that depend on those before them, over the rows of a partition in order.

``register(spark)`` makes them known; a call names the table, how its rows are grouped, and their order::

    SELECT * FROM context_within(TABLE(candidates) PARTITION BY (item_id) ORDER BY (rank), 6, 1800)
    SELECT * FROM composed_context(TABLE(candidates) PARTITION BY (item_id) ORDER BY (rank))

Spark shuffles and sorts the rows and makes one handler for each group.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.composing import POOL, compose


def _with(table: AnalyzeArgument, needed: tuple, **more) -> AnalyzeResult:
    """The table's own columns, which must have the needed ones, and others after them."""
    if not table.isTable:
        raise ValueError("the first argument is a TABLE(...)")
    lacking = [c for c in needed if c not in table.dataType.names]
    if lacking:
        raise ValueError(f"the table lacks {', '.join(lacking)}")
    schema = StructType(list(table.dataType.fields))
    for name, kind in more.items():
        schema = schema.add(name, kind)
    return AnalyzeResult(schema)


class ContextWithin:
    """Rows (tokens, ...) of a group in order that fit a budget: one that doesn't fit is skipped. Adds ``place``, from 0."""

    def __init__(self):
        self.used = self.taken = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, most: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        return _with(rows, ("tokens",), place=LongType())

    def eval(self, row, most, budget):
        tokens = row["tokens"] or 0
        if self.taken < most and self.used + tokens <= budget:
            yield (*row, self.taken)
            self.used += tokens
            self.taken += 1


class ComposedContext:
    """The composer's choice among the first POOL rows (document, page, heading, category, intent, ...) of a group. Adds ``place`` and ``reason``."""

    def __init__(self):
        self.rows = []

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return _with(rows, ("document", "page", "heading", "category", "intent"), place=LongType(), reason=StringType())

    def eval(self, row):
        if len(self.rows) < POOL:
            self.rows.append(row)

    def terminate(self):
        if self.rows:
            for place, (at, reason) in enumerate(compose([r.asDict() for r in self.rows], self.rows[0]["intent"])):
                yield (*self.rows[at], place, reason)


FUNCTIONS = {"context_within": ContextWithin, "composed_context": ComposedContext}


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
