"""What the SQL gate refuses, aggregates that Spark doesn't have, larger policy tables, policy files and the generator."""

import math

import pytest
from pyspark.sql import functions as F

from sparkwarden import queries
from sparkwarden.frame import GuardedFrame, col, function, when
from sparkwarden.plans import rewrite
from sparkwarden.plans.context import PolicyContext
from sparkwarden.policy import NotAllowed, PolicyViolation, parse
from sparkwarden.sources import generate
from sparkwarden.varied import ByRow

NAN = float("nan")
SMALL = [(2, 5), (3, 5), (3, 4), (1, 4), (5, 1)]


@pytest.fixture
def ctx(spark):
    c = PolicyContext(spark)
    c.register("i", spark.createDataFrame(SMALL, "a int, b int"), {"a": "top"})
    return c


@pytest.mark.parametrize("text", [
    "CREATE OR REPLACE TEMP VIEW v AS SELECT a FROM i", "DROP VIEW IF EXISTS i", "CACHE TABLE i", "SET x = 1", "SHOW TABLES", "DESCRIBE i", "EXPLAIN SELECT a FROM i", "INSERT INTO i VALUES (1, 2)",
    "FROM i INSERT OVERWRITE DIRECTORY '/tmp/never-written' USING parquet SELECT a", "SELECT a FROM nowhere_view", "SELECT a + 0 AS x FROM nowhere_view", "SELECT id FROM parquet.`/tmp/never-written`",
])
def test_refused(spark, ctx, text):
    spark.range(3).selectExpr("CAST(id AS INT) AS a").createOrReplaceTempView("nowhere_view")
    with pytest.raises(Exception) as e:
        ctx.sql(text)
    assert isinstance(e.value, NotAllowed) and ctx.last_error is e.value or "PATH_NOT_FOUND" in str(e.value)
    import os

    assert not os.path.exists("/tmp/never-written")


def test_unknown_steps_are_refused(ctx):
    """Every logical node of Spark that isn't named in the walk is refused, also over clean columns."""
    known = rewrite.PASSED | rewrite.MADE | rewrite.COMPARED | rewrite.OWN | rewrite.INLINE
    for text, node in (("SELECT transform(b) USING 'cat' AS x FROM i", "ScriptTransformation"), ("SELECT b FROM i |> TABLESAMPLE (10 PERCENT)", "Sample")):
        assert (node in known) == (node == "Sample")
        if node not in known:
            with pytest.raises(Exception) as e:
                ctx.sql(text)
            assert isinstance(e.value, PolicyViolation)


def test_allowed_and_options(spark, ctx):
    assert ctx.sql("SELECT b, row_number() OVER (ORDER BY b) AS r FROM (SELECT b FROM i)").verdict() == "allow"
    assert ctx.sql("SELECT * FROM VALUES (1, 'x') AS t(k, v)").verdict() == "allow"
    assert ctx.sql("SELECT b FROM i WHERE b IN (SELECT b FROM i WHERE a > 1) EXCEPT SELECT 4 AS b").verdict() == "allow"
    assert ctx.sql("SELECT a FROM i", enforce=False).verdict() == "allow"
    spark.range(3).createOrReplaceTempView("free_view")
    loose = PolicyContext(spark, allow_unregistered=True)
    assert loose.sql("SELECT id FROM free_view").release().count() == 3
    with pytest.raises(PolicyViolation):
        ctx.sql("SELECT a FROM i").release()
    assert ctx.show_policies()["i"]["a"] == ["top"]
    assert {k for k, _, _ in ctx.profile.report()} == {"register", "parse", "analyse", "check"}


def test_column_replaced_behind_the_context(spark, ctx):
    spark.sql("SELECT 1 AS a, 2 AS other").createOrReplaceTempView("i")
    with pytest.raises(NotAllowed):
        ctx.sql("SELECT other FROM i")


def test_user_functions_by_name(spark):
    spark.udf.register("mask_it", lambda x: 0, "int")
    c = PolicyContext(spark)
    c.register("i", spark.createDataFrame(SMALL, "a int, b int"), {"a": "T{mask_it}"})
    assert c.sql("SELECT mask_it(a) AS x FROM i").verdict() == "allow"
    with pytest.raises(PolicyViolation):
        c.sql("SELECT abs(a) AS x FROM i")


def test_aggregates(spark):
    rows = [(1, 3, 30.0), (2, 1, 10.0), (3, 2, NAN), (4, 9, 20.0)]
    g = GuardedFrame.register(spark.createDataFrame(rows, "k int, at int, v double"))
    out = g.agg(f=("first", col("v"), "k"), z=("last", col("v"), "at"), lo=("min", col("v")), hi=("max", col("v")), nlo=("nanmin", col("v")), nhi=("nanmax", col("v")), all=("groups", col("k")), n=("len", None, col("k") > 2)).release().first()
    assert (out.f, out.z, out.nlo, out.nhi, out.all, out.n) == (30.0, 20.0, 10.0, 30.0, [1, 2, 3, 4], 2)
    assert math.isnan(out.lo) and math.isnan(out.hi)
    q = {how: g.agg(q=("quantile", col("at"), 0.5, how)).release().first()[0] for how in ("linear", "lower", "higher", "midpoint", "nearest")}
    assert q == {"linear": 2.5, "lower": 2, "higher": 3, "midpoint": 2.5, "nearest": 3}  # 1.5 is between places 1 and 2
    sd = g.agg(a=("std", col("at")), b=("std", col("at"), 0), c=("var", col("at"), 0)).release().first()
    assert sd.a > sd.b and sd.c == pytest.approx(sd.b**2)
    with pytest.raises(ValueError):
        g.agg(f=("first", col("v")))
    assert g.group(k=3).release().count() == 1 and g.select("k", u=function("pi")).verdict() == "allow"


def test_expressions(spark):
    g = lambda p: GuardedFrame.register(spark.createDataFrame([("abcd", 2.55), (None, 1.0)], "s string, v double"), {"s": p, "v": "T{round:1}"})
    out = g("T{redact}").select(r=col("s").redact(), w=col("v").round(1), n=~col("v").is_null()).select("r", "w")
    assert [tuple(r) for r in out.release().collect()] == [("*", 2.6), (None, 1.0)]
    assert g("T{identity}").select(s=col("s").identity()).verdict() == "allow"
    with pytest.raises(PolicyViolation):
        g("T{identity}").select(s=col("s").redact())
    assert g("top").filter(col("s").starts_with("a") & col("s").ends_with("d") & ~col("s").like("x%")).select(x=when(col("s").is_null(), 1, 2)).release().first()[0] == 2


def test_more_policies_than_are_laid_out(spark):
    """Groups of a table with 12 policies are judged by those that their rows have, not by all."""
    rules = tuple((F.col("k") == i, f"A{{sum>={1 + i // 6}}} => T{{+:{i}}}") for i in range(12))
    df = spark.createDataFrame([(i, i % 3, i) for i in range(12)], "k int, g int, v int")
    f = GuardedFrame.register(df, {"v": ByRow((*rules, (F.col("k") == 99, "top")))})
    by = f.filter(col("k") < 6).group_by("k").agg(s=("sum", col("v")))
    assert by.filter(col("k") == 3).select(x=col("s") + 3).verdict() == "allow"
    assert by.filter(col("k") == 3).select(x=col("s") + 4).verdict() == "deny"
    assert f.group_by("k").agg(s=("sum", col("v"))).verdict() == "deny"
    assert f.filter(col("k") < 3).distinct().verdict() == "deny"
    clean = GuardedFrame.register(df, {"v": ByRow(tuple((F.col("k") == 50 + i, f"T{{+:{i}}}") for i in range(12)))})
    assert clean.group_by("v").agg(n=("len", None)).verdict() == "allow" and clean.distinct().verdict() == "allow"


def test_rows_of_a_protected_arm_count(spark):
    df = spark.createDataFrame(SMALL, "a int, b int")
    g = GuardedFrame.register(df, {"a": "A{sum>=2}"}).select("b", x=when(col("b") >= 4, col("a"), 0))
    assert g.agg(s=("sum", col("x"))).release().first()[0] == 9
    assert g.filter(col("b") == 1).agg(s=("sum", col("x"))).release().first()[0] == 0
    assert GuardedFrame.register(df, {"a": "A{sum>=2}"}).select(x=when(col("b") == 1, col("a"), 0)).agg(s=("sum", col("x"))).verdict() == "deny"


def test_chains_that_are_refused():
    for text in ("bot => top", "T{+:1} => top", "top => bot => top"):
        with pytest.raises(ValueError):
            parse(text)


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_generator_and_registering_files(spark, tmp_path, form):
    keys = ["l_orderkey", "l_linenumber"]
    generate.main(["/root/testdata/sf0.001", str(tmp_path), "--table", "lineitem", "--micro", "b", "--form", form, *(["--on", *keys] if form == "parquet" else [])])
    c = PolicyContext(spark)
    df = queries.table(spark, "/root/testdata/sf0.001", "lineitem").dropDuplicates(keys)
    c.register("lineitem", df, f"{tmp_path}/lineitem.policy.{form}", keys if form == "parquet" else None)
    assert c.sql("SELECT l_returnflag, max(l_discount) AS m FROM lineitem GROUP BY 1").verdict() == "allow"
    assert c.sql("SELECT l_discount FROM lineitem").verdict() == "deny"
    assert c.table("lineitem").group_by("l_returnflag").agg(m=("max", col("l_discount"))).verdict() == "allow"
    assert c.table("lineitem").select("l_discount").verdict() == "deny"
