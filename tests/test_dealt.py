"""Tables that meet in parts of bounded size."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexiforge import plans
from lexiforge.plans import parsing
from lexiforge.sources.shared import dealt

from .oracle import connected, differences

DIR = "/root/testdata/sf0.001"


def test_parts_have_a_bounded_number_of_rows(spark):
    rows = {"a": spark.range(1000).withColumnRenamed("id", "x"), "b": spark.range(10_000).selectExpr("id % 1000 AS y", "id")}
    made = dealt(rows, {"a": "x", "b": "y"}, 500)
    sizes = [r["count"] for r in made["b"].groupBy(F.spark_partition_id()).count().collect()]
    assert made["a"].rdd.getNumPartitions() == made["b"].rdd.getNumPartitions() == 20
    assert max(sizes) < 1_000 and sum(sizes) == 10_000


def test_activities_meet_in_such_parts(spark, monkeypatch):
    monkeypatch.setattr(parsing, "LINES", 300)
    made = plans.queries()["activity_faults"](spark, DIR)
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert re.findall(r"RepartitionByExpression \[[lo]_orderkey#\d+L?\], (\d+)", made._jdf.queryExecution().optimizedPlan().toString()) == [str(-(-lines // 300))] * 2
    assert not differences(made, connected(DIR), plans.oracle_sql()["activity_faults"])
