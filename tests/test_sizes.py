"""Sizes of groups whose rows a join repeats: right around the least size, and without sending the repeated rows."""

import re

import pytest
from pyspark.sql import functions as F

from sparkwarden import queries
from sparkwarden.frame import different
from sparkwarden.plans.context import PolicyContext

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [2, 3, 15, 16, 17, 20, 64, 1000])
def test_ids_are_told_apart_exactly_below_the_least_size(spark, k):
    """Groups of n ids, each in several rows of several tasks; group 0 has null ids alone."""
    sizes = sorted({0, 1, 2, *range(max(0, k - 3), k + 4), 2 * k, 40 * k})
    groups = spark.createDataFrame([(n,) for n in sizes], "n int")
    rows = groups.select("n", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias("i"), F.explode(F.array(*map(F.lit, range(5)))).alias("again"))
    rows = rows.select("n", F.when(F.col("n") > 0, F.xxhash64("n", "i")).alias("rid")).repartition(7)
    found = {r["n"]: r["d"] for r in rows.groupBy("n").agg(different(F.col("rid"), k).alias("d")).collect()}
    assert found.keys() == set(sizes)
    assert all(d == n if n < k else d >= k for n, d in found.items())


@pytest.mark.parametrize("k", [2, 30])
def test_repeated_rows_are_not_sent(spark, k):
    """Tasks send a row for each nation, not one for each order and nation: exchanges go by the nation alone."""
    orders, nation = queries.table(spark, SF, "orders"), queries.table(spark, SF, "nation")
    ctx = PolicyContext(spark)
    ctx.register("orders", orders, {"o_totalprice": f"A{{sum>={k}}}"}, keys=[["o_orderkey"]])
    ctx.register("nation", nation, keys=[["n_nationkey"]])
    plan = ctx.sql("SELECT n_name, sum(o_totalprice) AS s FROM orders, nation GROUP BY n_name").release()._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"hashpartitioning\((.*?)\)", plan)
    assert sent and all(re.fullmatch(r"n_name#\d+, \d+", x) for x in sent)


@pytest.mark.parametrize("k, verdict", [(29, "allow"), (30, "allow"), (31, "deny")])
def test_verdict_at_the_least_size(spark, k, verdict):
    ctx = PolicyContext(spark)
    ctx.register("t", spark.range(30).selectExpr("id", "id % 2 AS g", "id * 1.5 AS v"), {"v": f"A{{sum>={k}}}"}, keys=[["id"]])
    ctx.register("u", spark.range(9).selectExpr("id AS j"), keys=[["j"]])
    assert ctx.sql("SELECT j, sum(v) AS s FROM t, u GROUP BY j").verdict() == verdict
    assert ctx.sql("SELECT j, sum(v) FILTER (WHERE g = 0) AS s FROM t, u GROUP BY j").verdict() == "deny"
