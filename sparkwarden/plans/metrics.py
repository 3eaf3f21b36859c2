"""What a query's steps cost: rows and milliseconds of each operator of the plan that ran, by Spark's own metrics, and the tests of policies in it."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..frame import MARK

#: Nodes that only stand around others: what they have inside is told instead.
AROUND = ("AdaptiveSparkPlan", "ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage", "ResultQueryStage", "InputAdapter")
#: Metric types in milliseconds, and what they must be divided by.
TIMES = {"timing": 1, "nsTiming": 1_000_000}


@dataclass(frozen=True)
class Step:
    """An operator: how deep it stands in the plan, its output rows (where Spark counts them), its time, and how many tests of policies it has."""

    depth: int
    name: str
    rows: int | None
    milliseconds: float
    tests: int


def measured(df: DataFrame) -> list[Step]:
    """Runs the plan, with all its columns, and reads its metrics. Rows stay on the executors."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    out: list[Step] = []
    _walk(query.executedPlan(), 0, out)
    return out


def _walk(p: Any, depth: int, out: list[Step]) -> None:
    name = p.nodeName().split(" ")[0]
    if name in AROUND:
        inner = p.executedPlan() if name == "AdaptiveSparkPlan" else p.plan() if name.endswith("QueryStage") else p.child()
        return _walk(inner, depth, out)
    rows, spent = None, 0.0
    metrics = p.metrics().toSeq()
    for i in range(metrics.size()):
        pair = metrics.apply(i)
        key, metric = pair._1(), pair._2()
        if key == "numOutputRows":
            rows = metric.value()
        elif (per := TIMES.get(metric.metricType())) and metric.value() > 0:
            spent += metric.value() / per
    tests = p.expressions().mkString("\n").count(MARK)
    out.append(Step(depth, name, rows, spent, tests))
    for kind in (p.children(), p.subqueries()):
        for i in range(kind.size()):
            _walk(kind.apply(i), depth + 1, out)
