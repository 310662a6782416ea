"""Checks of generated plans and answers, and JSON in noisy text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DECODER = json.JSONDecoder()


def objects_in(text: str | None) -> list[str]:
    """Every object that can be decoded from a brace of a text, nested ones included, in order."""
    found = []
    at = (text or "").find("{")
    while at >= 0:
        try:
            value, _ = _DECODER.raw_decode(text, at)
            found.append(json.dumps(value, ensure_ascii=False, sort_keys=True))
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return found


def json_objects(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, object): the JSON objects in each text."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array(map(objects_in, texts.to_pylist()), pa.list_(pa.string()))

    return rows.select(key, F.posexplode(found(F.col(body))).alias("place", "object"))


def best_object(objects: DataFrame, key: str, required: list[str], weights: dict[str, float]) -> DataFrame:
    """Of each key the first object with all required names and the largest weight of names."""
    names = F.json_object_keys("object")
    weight = sum((F.when(F.array_contains(names, n), F.lit(float(w))).otherwise(0.0) for n, w in weights.items()), F.lit(0.0))
    sound = objects.filter(F.size(F.array_except(F.array(*map(F.lit, required)), names)) == 0)
    return sound.groupBy(key).agg(F.max_by("object", F.struct(weight, -F.col("place"))).alias("object"))


def unknown_references(items: DataFrame, allowed: DataFrame, key: str, references: str) -> DataFrame:
    """(key, reference): what an item refers to though it isn't allowed."""
    each = items.select(key, F.explode(references).alias("reference")).distinct()
    return each.join(allowed.select("reference"), "reference", "left_anti").select(key, "reference")


def plan_faults(plans: DataFrame) -> DataFrame:
    """``plans`` (minutes, steps array<struct<phase, minutes, materials>>) with their faults."""
    total = F.aggregate("steps", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["minutes"], F.lit(0)))
    phases = F.transform("steps", lambda x: F.lower(F.trim(x["phase"])))
    faults = F.array_compact(
        F.array(
            F.when(F.coalesce(F.size("steps"), F.lit(0)) <= 0, "no_steps"),
            F.when(total != F.col("minutes"), "duration_mismatch"),
            F.when(F.exists("steps", lambda x: F.coalesce(x["minutes"], F.lit(0)) <= 0), "empty_step"),
            F.when(F.size(F.array_distinct(phases)) < F.size("steps"), "repeated_phase"),
            F.when(F.exists("steps", lambda x: F.coalesce(F.trim(x["materials"]), F.lit("")) == ""), "no_materials"),
        )
    )
    return plans.withColumn("faults", faults)


def repeated_across(sections: DataFrame, owner: str, section: str, signature: str) -> DataFrame:
    """(owner, signature, sections): what several sections of an owner have."""
    return sections.groupBy(owner, signature).agg(F.countDistinct(section).alias("sections")).filter("sections > 1")


def allowed_table(spark: SparkSession, kind: str, n: int) -> DataFrame:
    """The references kind:1 to kind:n."""
    return spark.range(1, n + 1).select(F.concat(F.lit(f"{kind}:"), F.col("id").cast("string")).alias("reference"))
