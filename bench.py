"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line. Each guarded query runs beside the same plain one, in
turns, after a run that warms both up; seconds are medians, and overhead is guarded over plain."""

import json
import math
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from sparkwarden import queries as base

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
MORE = ("rollup", "cube", "window_mean", "window_frame", "joined_sum")
PAIRS = {k: f"guarded_sql_{k}" for k in base.SQL if k.startswith("tpch") or k in MORE}
ALONE = [k for k in base.QUERIES if k.startswith("micro") or k.startswith("guarded_by_ids") or k in ("guarded_q1", "groupsize_ok", "by_row", "by_row_sql", "by_row_sql_join", "dsl_aggregates")]
TURNS = 2

spark = (
    SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
    .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")


def run(name: str) -> float:
    began = time.time()
    base.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    return time.time() - began


found: dict[str, float] = {}
for names in [*([k, g] for k, g in PAIRS.items()), *([k] for k in ALONE)]:
    for k in names:
        run(k)
    times = [[run(k) for k in (names if turn % 2 else names[::-1])][:: 1 if turn % 2 else -1] for turn in range(TURNS)]
    found |= {k: round(median(t[i] for t in times), 4) for i, k in enumerate(names)}
ratio = {k: round(found[g] / found[k], 3) for k, g in PAIRS.items()}
mean = math.exp(sum(math.log(x) for x in ratio.values()) / len(ratio))
print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": SF, "overhead": ratio, "overhead_geomean": round(mean, 3)}))
