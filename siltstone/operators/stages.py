"""Ordered stages over a table of requests: each sets columns of the rows that need it and can still pay for it. One plan, no shuffle."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Stage(NamedTuple):
    """A stage runs on a row if it is enabled, should_run holds (null: it does not) and budget_ms is least_ms or more; it then costs cost_ms."""

    name: str
    sets: dict[str, Column]
    should_run: Column
    least_ms: float = 0.0
    cost_ms: float = 0.0
    enabled: bool = True


def run(requests: DataFrame, stages: list[Stage]) -> DataFrame:
    """requests (budget_ms, ...), with every column that a stage sets, after all stages; trace holds the names of those that ran, in order."""
    out = requests.withColumn("trace", F.array().cast("array<string>"))
    for s in stages:
        if s.enabled:
            go = F.coalesce(s.should_run, F.lit(False)) & (F.col("budget_ms") >= s.least_ms)
            then = {c: F.when(go, e).otherwise(F.col(c)) for c, e in s.sets.items()}
            out = out.withColumns({**then, "budget_ms": F.col("budget_ms") - F.when(go, s.cost_ms).otherwise(0.0), "trace": F.when(go, F.array_append("trace", F.lit(s.name))).otherwise(F.col("trace"))})
    return out
