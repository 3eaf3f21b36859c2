"""Groups of correlated subqueries that no outer row asks for break no policy; those that one asks for do."""

import pytest
from pyspark.sql import functions as F

from sparkwarden import queries
from sparkwarden.frame import MARK
from sparkwarden.plans.context import PolicyContext
from sparkwarden.policy import PolicyViolation

SMALL = "(SELECT 2 * avg(v) FROM cells WHERE g = k)"


@pytest.fixture(scope="module")
def ctx(spark):
    """Cells of groups 1 (of 4), 2 (of one) and 3 (of 4); parts a: 1, 3 and 9 (without cells), b: 2."""
    ctx = PolicyContext(spark)
    cells = [(g, float(v)) for g, n in ((1, 4), (2, 1), (3, 4)) for v in range(n)]
    ctx.register("cells", spark.createDataFrame(cells, "g long, v double"), {"v": "A{mean>=3, sum>=3, max>=3}"})
    ctx.register("parts", spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (9, "a")], "k long, brand string"), keys=[["k"]])
    return ctx


def rows(ctx, text):
    return sorted(map(tuple, ctx.sql(text).release(now=True).collect()), key=str)


@pytest.mark.parametrize("text, want", [
    (f"SELECT k, {SMALL} AS m FROM parts WHERE brand = 'a'", [(1, 3.0), (3, 3.0), (9, None)]),
    (f"SELECT k FROM parts WHERE brand = 'a' AND {SMALL} > 1", [(1,), (3,)]),
    ("SELECT k, (SELECT coalesce(sum(v), -1) FROM cells WHERE g = k) AS m FROM parts WHERE brand = 'a'", [(1, 6.0), (3, 6.0), (9, -1.0)]),
    ("SELECT k, (SELECT x + 1 FROM (SELECT max(v) AS x FROM cells WHERE g = k)) AS m FROM parts WHERE brand = 'a'", [(1, 4.0), (3, 4.0), (9, None)]),
    ("SELECT k, m FROM parts, LATERAL (SELECT avg(v) AS m FROM cells WHERE g = k) WHERE brand = 'a'", [(1, 1.5), (3, 1.5), (9, None)]),
    ("SELECT k, n FROM parts, LATERAL (SELECT avg(v) AS m, count(*) AS n FROM cells WHERE g = k)", [(1, 4), (2, 1), (3, 4), (9, 0)]),
    (f"SELECT brand, CASE WHEN brand = 'a' THEN {SMALL} END AS m FROM parts", [("a", 3.0), ("a", 3.0), ("a", None), ("b", None)]),
])
def test_groups_that_nobody_asks_for(ctx, text, want):
    assert rows(ctx, text) == want


@pytest.mark.parametrize("text", [
    f"SELECT k, {SMALL} AS m FROM parts", f"SELECT k FROM parts WHERE {SMALL} > 1", f"SELECT k FROM parts WHERE {SMALL} IS NULL",
    "SELECT k, (SELECT coalesce(sum(v), -1) FROM cells WHERE g = k) AS m FROM parts", "SELECT k, (SELECT x + 1 FROM (SELECT max(v) AS x FROM cells WHERE g = k)) AS m FROM parts",
    "SELECT k, (SELECT avg(v) FROM cells WHERE g = k HAVING avg(v) > 1) AS m FROM parts", "SELECT k, (SELECT avg(v) FROM cells WHERE g = k HAVING avg(v) < 0) AS m FROM parts",
    "SELECT k, m FROM parts, LATERAL (SELECT avg(v) AS m FROM cells WHERE g = k)", "SELECT k FROM parts, LATERAL (SELECT avg(v) AS m FROM cells WHERE g = k) WHERE m IS NULL",
    "SELECT k FROM parts JOIN LATERAL (SELECT avg(v) AS m FROM cells WHERE g = k) ON m > 1", "SELECT k FROM parts WHERE EXISTS (SELECT 1 FROM cells WHERE g = k HAVING avg(v) > 1)",
    "SELECT k, (SELECT (SELECT x + 1) FROM (SELECT avg(v) AS x FROM cells WHERE g = k)) AS m FROM parts", "SELECT k, (SELECT count(*) + max(v) FROM cells WHERE g = k) AS m FROM parts",
    "SELECT sum(m) AS s FROM (SELECT (SELECT avg(v) FROM cells WHERE g = k) AS m FROM parts)",
])
def test_groups_that_are_asked_for(ctx, text):
    with pytest.raises(PolicyViolation):
        rows(ctx, text)


def test_error_of_the_plan_itself(ctx):
    df = ctx.sql(f"SELECT k, {SMALL} AS m FROM parts").release()
    with pytest.raises(Exception, match=MARK + "avg over too small a group"):
        df.collect()
    assert df.where(F.col("k") != 2).count() == 3


def test_q17_with_a_small_part_of_another_brand(spark, tmp_path):
    """Of one part of another brand only three lines are left, fewer than the policy asks for: nobody asks for its mean."""
    sf = "/root/testdata/sf0.01"
    part, lines = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/lineitem.parquet")
    key = part.where("p_brand <> 'Brand#12'").agg(F.min("p_partkey")).first()[0]
    few = lines.where(F.col("l_partkey") == key).limit(3)
    part.write.parquet(f"{tmp_path}/part.parquet")
    lines.where(F.col("l_partkey") != key).union(few).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = queries.QUERIES["tpch_q17"](spark, str(tmp_path)).collect()
    assert queries.QUERIES["guarded_sql_tpch_q17"](spark, str(tmp_path)).collect() == want
    # a part of the brand itself does break it
    key = part.where("p_brand = 'Brand#12'").agg(F.min("p_partkey")).first()[0]
    few = lines.where(F.col("l_partkey") == key).limit(3)
    lines.where(F.col("l_partkey") != key).union(few).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    with pytest.raises(Exception, match=MARK + "avg over too small a group"):
        queries.QUERIES["guarded_sql_tpch_q17"](spark, str(tmp_path)).collect()
