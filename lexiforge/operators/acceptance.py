"""An acceptance report of a retrieval chain: what each stage finds for each case, what a stage gains over the one before, why a case fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stages in order; the last is the context that is handed on.
STAGES = ("A", "B", "C", "D")
TOP = 10


def cases(hits: DataFrame, case: str) -> DataFrame:
    """One row for each (stage, case) of ``hits`` (stage, case, place, id, copy, topic, desired, concrete, tokens), with what it gains over the stage before.

    ``place`` counts from 1, ``copy`` is equal for equal contents; ``topic``, ``desired`` and ``concrete`` are boolean.
    """
    n = F.count("*")
    best = lambda c, k: F.bool_or(F.col(c) & (F.col("place") <= k))
    found = hits.groupBy("stage", case).agg(
        n.alias("hits"), F.round(F.avg(F.col("topic").cast("int")), 6).alias("topic"), best("desired", 10**9).alias("desired"), best("desired", 3).alias("desired_3"), best("desired", 5).alias("desired_5"),
        F.min(F.when(F.col("desired"), F.col("place"))).alias("first_desired"), best("concrete", 5).alias("concrete_5"), best("concrete", 10**9).alias("concrete"),
        F.round((n - F.count_distinct("copy")) / n, 6).alias("duplicate_rate"), F.sum("tokens").alias("tokens"),
    )
    before = F.lag("topic").over(Window.partitionBy(case).orderBy("stage"))
    return found.withColumn("gain", F.col("topic") - before)


def report(rows: DataFrame, budget: int) -> DataFrame:
    """One row for each stage of ``cases``, and one over all stages (stage null): a pass with grouping sets.

    ``decision`` is READY where the last stage has neither copies nor contexts over the budget, and is stated for that stage only.
    """
    count = lambda c: F.count_if(F.col(c))
    last = F.col("stage") == STAGES[-1]
    measures = [
        F.count("*").alias("cases"), F.round(F.avg("topic"), 6).alias("topic"), *[count(c).alias(c) for c in ("desired", "desired_3", "desired_5", "concrete_5", "concrete")], F.round(F.avg("first_desired"), 6).alias("mean_first_desired"),
        F.round(F.avg("duplicate_rate"), 6).alias("duplicate_rate"), F.count_if(F.col("gain") > 0).alias("improved"), F.count_if(F.col("gain") == 0).alias("unchanged"), F.count_if(F.col("gain") < 0).alias("regressed"),
        F.count_if(last & (F.col("tokens") > budget)).alias("overflows"), F.bool_or(last & ((F.col("duplicate_rate") > 0) | (F.col("tokens") > budget))).alias("__bad"), F.bool_or(last).alias("__last"),
    ]
    made = rows.groupingSets([[F.col("stage")], []], F.col("stage")).agg(*measures)
    return made.withColumn("decision", F.when(F.col("stage").isNotNull() & F.col("__last"), F.when(F.col("__bad"), "NOT_READY").otherwise("READY"))).drop("__bad", "__last")


def diagnosis(rows: DataFrame, wide: DataFrame, case: str) -> DataFrame:
    """(case, labels): why a case isn't served; ``wide`` (case, desired, concrete) says what its whole pool of candidates holds."""
    at = lambda stage, c: F.coalesce(F.bool_or(F.when(F.col("stage") == stage, F.col(c))), F.lit(False))
    each = rows.groupBy(case).agg(at("C", "desired").alias("top"), at("D", "desired").alias("final"))
    both = each.join(wide.withColumnRenamed("desired", "pool").withColumnRenamed("concrete", "strong"), case, "left")
    pool, strong = F.coalesce("pool", F.lit(False)), F.coalesce("strong", F.lit(False))
    labels = F.array_compact(
        F.array(
            F.when(~F.col("top") & pool, "RANKING_LIMITATION"),
            F.when(~pool & ~strong, "RETRIEVAL_COVERAGE_LIMITATION"),
            F.when(F.col("top") & ~F.col("final"), "COMPOSITION_LOSS"),
            F.when(~strong, "NO_STRONG_CONCRETE_AVAILABLE"),
        )
    )
    return both.select(case, F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise("NO_LIMITATION_DETECTED").alias("labels"))
