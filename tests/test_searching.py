"""The search for exercises lower-cases a block once, not for each word of each request."""

from __future__ import annotations

import re

from lexiforge import plans


def test_blocks_are_lowered_once(spark):
    plan = plans.queries()["exercise_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    held = re.findall(r"(?i)contains\(([^,]*), lambda", plan)
    assert held and all(re.fullmatch(r"_?\w*low#\d+", x) for x in held), held
