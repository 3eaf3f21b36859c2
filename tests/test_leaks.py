"""Ways to a protected cell that the gate must close: verdicts over given tables, leaves of plans, random queries, row ids and budgets."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwarden import anonymity, queries
from sparkwarden.frame import MARK, GuardedFrame, as_expr, col, function, lit, when
from sparkwarden.noise import Budget
from sparkwarden.plans import rewrite
from sparkwarden.plans.context import PolicyContext
from sparkwarden.policy import Duplicate, NotAllowed, NotFound, PolicyViolation, from_json, parse, to_json
from sparkwarden.sources import policies as files
from sparkwarden.sources.rows import positions
from sparkwarden.varied import ByRow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cases(spark):
    return queries.cases(spark, SF)


@pytest.mark.parametrize("name", list(queries.EXPECTED))
def test_verdict(cases, name):
    make, want = cases[name]
    try:
        found = make().verdict()
    except PolicyViolation:
        found = "deny"
    assert found == want == queries.EXPECTED[name]


def test_every_case_is_expected(cases):
    assert cases.keys() == queries.EXPECTED.keys()


@pytest.mark.parametrize("make", [lit, as_expr, lambda c: col("k").is_in(1, c), lambda c: col("k").between(0, c), lambda c: function("abs", c), lambda c: col("k") + c, lambda c: col("k").substring(1, c), lambda c: when(col("k") > 1, c, 0), lambda c: col("k").like(c)])
def test_columns_are_no_values(spark, make):
    with pytest.raises(TypeError):
        make(F.col("secret"))


def test_unknown_leaves_are_refused(spark):
    """Of all of Spark's expressions without children only those named here pass, and none of them is an attribute."""
    jvm = spark._jvm
    registry = spark._jsparkSession.sessionState().functionRegistry()
    names = [registry.listFunction().apply(i).funcName() for i in range(registry.listFunction().size())]
    ctx = PolicyContext(spark)
    ctx.register("t", spark.createDataFrame([(1, 2)], "k int, secret int"), {"secret": "top"})
    tried, refused = 0, 0
    for name in names:
        try:
            e = spark.sql(f"SELECT `{name}`() AS x FROM t")._jdf.queryExecution().analyzed().expressions().apply(0)
        except Exception:
            continue
        inner = e.child()
        if inner.children().size():
            continue
        tried += 1
        try:
            assert ctx.sql(f"SELECT `{name}`() AS x FROM t").policies["x"].released and rewrite.what(inner) in rewrite.LEAVES
        except PolicyViolation:
            refused += 1
            assert rewrite.what(inner) not in rewrite.LEAVES
    assert tried > 10 and refused > 0
    assert not rewrite.LEAVES & {"AttributeReference", "OuterReference", "UnresolvedAttribute", "BoundReference", "GetColumnByOrdinal", "ScalarSubquery"}
    assert jvm is not None


def test_random_queries_give_no_cell(spark):
    """Correlated, lateral, renamed and nested queries over a column that nothing may release: whatever comes out isn't one of its cells."""
    rng = random.Random(7)
    secret = {10**6 + i for i in range(40)}
    df = spark.createDataFrame([(i, i % 5, v) for i, v in enumerate(sorted(secret))], "k int, g int, s int")
    ctx = PolicyContext(spark)
    ctx.register("t", df, {"s": "top"})
    ctx.register("u", spark.createDataFrame([(i,) for i in range(5)], "j int"))

    def value(depth, names):
        name = rng.choice(names)
        if not depth or rng.random() < 0.3:
            return name
        inner = value(depth - 1, names)
        return rng.choice([
            f"(SELECT {inner})", f"(SELECT max({inner}) FROM u)", f"CASE WHEN {rng.choice(names)} > 3 THEN {inner} ELSE 0 END", f"coalesce({inner}, 0)", f"abs({inner})", f"{inner} + 0",
            f"element_at(array({inner}), 1)", f"transform(array({inner}), x -> x)[0]", f"(SELECT x FROM (SELECT {inner} AS x UNION ALL SELECT {inner}) LIMIT 1)", f"max({inner}) OVER (PARTITION BY {rng.choice(names)})",
        ])

    def source(depth):
        if not depth:
            return "t a", ["a.k", "a.g", "a.s"]
        below, names = source(depth - 1)
        v = value(2, names)
        return rng.choice([
            (f"(SELECT {v} AS k, {names[1]} AS g, {value(1, names)} AS s FROM {below}) a", ["a.k", "a.g", "a.s"]),
            (f"{below}, LATERAL (SELECT {v} AS y) b{depth}", [*names, f"b{depth}.y"]), (f"{below} JOIN u c{depth} ON c{depth}.j < 2", [*names, f"c{depth}.j"]),
            (f"(SELECT * FROM (SELECT {v} AS k, {names[1]} AS g, {names[0]} AS s FROM {below}) UNION ALL SELECT k, g, s FROM t) a", ["a.k", "a.g", "a.s"]),
        ])

    ran = released = 0
    for _ in range(120):
        below, names = source(rng.randrange(3))
        try:
            out = ctx.sql(f"SELECT {value(2, names)} AS x, {rng.choice(names)} AS y FROM {below}").release().collect()
        except PolicyViolation:
            ran += 1
            continue
        except Exception as e:
            if MARK in str(e):
                ran += 1
            continue  # not SQL that Spark takes
        ran, released = ran + 1, released + 1
        assert not {v for r in out for v in r} & secret
    assert ran > 40 and released > 5


def test_row_ids_and_keys(spark):
    """A join on a declared key needs no ids, and gives the same verdicts as one that has to count them."""
    orders, items = (queries.table(spark, SF, t) for t in ("orders", "lineitem"))
    text = "SELECT o_orderstatus, sum(l_quantity) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus"
    plans, rows = [], []
    for keys in ([], [["o_orderkey"]]):
        ctx = PolicyContext(spark)
        ctx.register("lineitem", items, {"l_quantity": "A{sum>=20}"})
        ctx.register("orders", orders, keys=keys)
        df = ctx.sql(text).release()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        rows.append({r[0]: round(r[1], 3) for r in df.collect()})
    assert rows[0] == rows[1] and "row_index" in plans[0] and "row_index" not in plans[1]
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plans[1]


def test_one_run(spark):
    """The test of a group's size is part of the aggregate: the table is read once."""
    ctx = PolicyContext(spark)
    ctx.register("lineitem", queries.table(spark, SF, "lineitem"), {"l_quantity": "A{sum>=20}"})
    df = ctx.sql("SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem GROUP BY l_returnflag").release()
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    small = ctx.sql("SELECT l_orderkey, sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey")
    with pytest.raises(Exception, match=MARK):
        small.release().collect()
    assert small.verdict() == "deny" and small.release().select("l_orderkey").count() > 0  # no sum is computed for anyone


def test_budget(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k int, v double")
    budget = Budget(1.0)
    g = GuardedFrame.register(df, {"v": "N{0.5,}"}, budgets={"v": budget})
    noisy = g.select("k", x=col("v").clip(0, 10).laplace(0.5))
    one = [r.x for r in noisy.release().collect()]
    assert budget.left == 0.5 and noisy.verdict() == "allow" and budget.left == 0.5
    two = g.with_columns(y=col("v").clip(0, 10)).agg(s=("laplace_sum", col("v").clip(0, 10), 0.4))
    assert abs(two.release().first()[0] - sum(min(i, 10) for i in range(100))) < 10 / 0.4 * 40
    assert budget.left == pytest.approx(0.1) and len({round(a - min(i, 10), 6) for i, a in enumerate(one)}) > 90
    with pytest.raises(PolicyViolation, match="is left"):
        noisy.release()
    with pytest.raises(PolicyViolation, match="is left"):
        g.agg(n=("laplace_count", col("v"), 0.2)).release()
    assert budget.left == pytest.approx(0.1)
    for bad in (lambda: col("v").laplace(0.5), lambda: col("v").laplace(0.5, 0.0), lambda: col("v").laplace(0.0, 1.0), lambda: col("v").clip(1, 1), lambda: Budget(0), lambda: g.agg(s=("laplace_sum", col("v"), 0.1))):
        with pytest.raises(ValueError):
            bad()


def test_policy_files_by_key(spark, tmp_path):
    df = spark.createDataFrame([(1, 200.0), (2, 5.0), (None, 7.0), (3, 9.0)], "k int, v double")
    ids = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1), (None, 1)], "k int, v int")
    files.write_parquet(ids, {"v": [parse("A{sum>=2}"), parse("clean")]}, f"{tmp_path}/p")
    g = files.read_parquet(spark, df, f"{tmp_path}/p", ["k"])
    assert g.filter(col("k") == 1).agg(s=("sum", col("v"))).verdict() == "deny"  # one row, though its key stands there twice
    assert g.filter(col("k").is_null()).release().count() == 1 and g.filter(col("k") == 2).verdict() == "deny" and g.filter(col("k") == 3).verdict() == "deny"
    assert files.read_parquet(spark, df, f"{tmp_path}/p", ["k"], missing="clean").filter(col("k") == 3).release().count() == 1


def test_policy_files_by_place(spark, tmp_path):
    """A policy for each cell, without a key, over several files, as Parquet and as JSON."""
    spark.range(0, 40, 1, 4).selectExpr("id AS k", "id * 2 AS v").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    at = {r._position: r.k for r in positions(df).collect()}
    assert sorted(at) == list(range(40)) and sorted(at.values()) == list(range(40))
    ids = spark.createDataFrame([(p, int(k % 4 == 0)) for p, k in at.items()], "position long, v int")
    files.write_dense(ids, {"v": [parse("clean"), parse("top")]}, f"{tmp_path}/cells")
    text = files.dumps([[parse("clean")] * 40, [parse("top" if at[p] % 4 == 0 else "clean") for p in range(40)]])
    (tmp_path / "cells.json").write_text(text)
    for path in (f"{tmp_path}/cells", f"{tmp_path}/cells.json"):
        ctx = PolicyContext(spark)
        ctx.register("t", df, path)
        assert sorted(r[0] for r in ctx.sql("SELECT k FROM t").release().collect()) == list(range(40))
        assert ctx.sql("SELECT v FROM t").verdict() == "deny" and ctx.sql("SELECT v FROM t WHERE k % 4 <> 0").release().count() == 30
        assert ctx.table("t").filter(col("k") == 5).release().first().v == 10
    with pytest.raises(ValueError):
        positions(spark.range(3))
    # a column with one policy beside one with a policy for each cell: its rows are counted once as well
    (tmp_path / "both.json").write_text(files.dumps([[parse("A{sum>=2}")], [parse("top" if at[p] % 4 == 0 else "clean") for p in range(40)]]))
    ctx = PolicyContext(spark)
    ctx.register("t", df, f"{tmp_path}/both.json")
    ctx.register("n", spark.range(20).toDF("n"))
    assert ctx.sql("SELECT sum(k) AS s FROM t, n WHERE k = 5").verdict() == "deny" and ctx.sql("SELECT sum(k) AS s FROM t, n WHERE k < 7").verdict() == "allow"


def test_several_arguments():
    p = parse("T{substring:1:2, year} => A{max>=3}")
    assert from_json(to_json(p)) == p == parse(str(p)) and files.loads(files.dumps([[p]])) == [[p]]


def test_anonymity(spark):
    rows = [("a", 1, "x")] * 3 + [("a", 2, "x"), ("a", 2, "y")] + [(None, 1, "x")] * 2 + [(None, 1, None)] * 2
    df = spark.createDataFrame(rows, "q string, r int, s string")
    g = GuardedFrame.register(df, {"q": "T{k_anonymous:3}", "r": "T{k_anonymous:3}"})
    assert g.verdict() == "deny" and anonymity.k_anonymous(g, ["q", "r"], 3).verdict() == "deny"
    assert anonymity.k_anonymous(g, ["q", "r"], 3, suppress=True).release().count() == 7
    with pytest.raises(PolicyViolation):
        anonymity.k_anonymous(g, ["q", "r"], 2)
    free = GuardedFrame.register(df)
    assert anonymity.k_anonymous(free, ["q", "r"], 2).release().count() == 9
    assert anonymity.l_diverse(free, ["q", "r"], "s", 2, suppress=True).release().count() == 6 and anonymity.l_diverse(free, ["q", "r"], "s", 2).verdict() == "deny"
    share = {"x": 6 / 9, "y": 1 / 9, None: 2 / 9}
    classes = {("a", 1): ["x"] * 3, ("a", 2): ["x", "y"], (None, 1): ["x", "x", None, None]}
    far = {k: sum(abs(v.count(s) / len(v) - w) for s, w in share.items()) / 2 for k, v in classes.items()}
    for most in (0.0, 0.2, 0.3, 0.35, 0.5):
        want = sum(len(classes[k]) for k, d in far.items() if d <= most + 1e-9)
        assert anonymity.t_close(free, ["q", "r"], "s", most, suppress=True).release().count() == want


def test_rows_of_groups(spark):
    g = GuardedFrame.indexed(queries.table(spark, SF, "orders"), {"o_totalprice": "top"})
    out = g.group_by("o_orderstatus").agg(rows=("groups", col("row"))).release().collect()
    assert sorted(x for r in out for x in r.rows) == list(range(queries.table(spark, SF, "orders").count()))
    assert NotAllowed.code != PolicyViolation.code


def test_by_row_agrees_with_frames(spark):
    df = queries.table(spark, SF, "customer")
    rules = ByRow(((F.col("c_acctbal") < 0, "top"), (F.col("c_custkey") % 3 == 0, "A{sum>=2}")))
    ctx = PolicyContext(spark)
    ctx.register("c", df, {"c_acctbal": rules})
    g = GuardedFrame.register(df, {"c_acctbal": rules})
    assert ctx.sql("SELECT c_acctbal FROM c WHERE c_acctbal >= 0 AND c_custkey % 3 <> 0").release().count() == g.filter((col("c_acctbal") >= 0) & (col("c_custkey") % 3 != 0)).select("c_acctbal").release().count()
    for text, frame in (
        ("SELECT c_mktsegment, sum(c_acctbal) AS s FROM c WHERE c_acctbal >= 0 GROUP BY 1", lambda: g.filter(col("c_acctbal") >= 0).group_by("c_mktsegment").agg(s=("sum", col("c_acctbal")))),
        ("SELECT c_custkey, sum(c_acctbal) AS s FROM c WHERE c_acctbal >= 0 GROUP BY 1", lambda: g.filter(col("c_acctbal") >= 0).group_by("c_custkey").agg(s=("sum", col("c_acctbal")))),
        ("SELECT c_mktsegment, sum(c_acctbal) AS s FROM c GROUP BY 1", lambda: g.group_by("c_mktsegment").agg(s=("sum", col("c_acctbal")))),
        ("SELECT DISTINCT c_acctbal FROM c WHERE c_acctbal >= 0", lambda: g.filter(col("c_acctbal") >= 0).select("c_acctbal").distinct()),
    ):
        assert ctx.sql(text).verdict() == frame().verdict()


def test_what_tests_cost(spark):
    """Spark's metrics by operator: the aggregate holds the test, rows agree with a plain run, and nothing is scanned twice."""
    ctx = PolicyContext(spark)
    ctx.register("lineitem", queries.table(spark, SF, "lineitem"), {"l_quantity": "A{sum>=20}"})
    text = "SELECT l_returnflag, sum(l_quantity) AS s FROM lineitem WHERE l_linenumber < 5 GROUP BY l_returnflag"
    guarded, bare = ctx.measure(text), ctx.measure(text, enforce=False)
    assert sum(s.tests for s in guarded) > 0 and not any(s.tests for s in bare)
    assert all("Aggregate" in s.name or s.name == "Project" for s in guarded if s.tests)
    for steps in (guarded, bare):
        scans = [s for s in steps if s.name.startswith("Scan")]
        assert len(scans) == 1 and scans[0].rows == queries.table(spark, SF, "lineitem").count() and sum(s.milliseconds for s in steps) > 0
        assert next(s.rows for s in steps if "Aggregate" in s.name) == 3
    assert {k for k, _, _ in ctx.profile.report()} >= {"register", "check", "measure"}


def test_kinds_of_errors(spark):
    ctx = PolicyContext(spark)
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    ctx.register("t", df, {"a": ByRow((("b > 1", "top"),))})
    for make, kind, code in (
        (lambda: ctx.table("nowhere"), NotFound, "not found"), (lambda: ctx.table("t").select("c"), NotFound, "not found"), (lambda: ctx.sql("SELECT a, b AS A FROM t"), Duplicate, "duplicate"),
        (lambda: ctx.table("t").join(ctx.table("t").select("a", "b"), ["a"]), Duplicate, "duplicate"), (lambda: ctx.sql("SET x = 1"), NotAllowed, "invalid operation"),
    ):
        with pytest.raises(kind) as e:
            make()
        assert e.value.code == code
    assert isinstance(ctx.last_error, NotAllowed)
    assert [tuple(r) for r in ctx.table("t").policy_cells().collect()] == [("top", "clean")]


def test_users_aggregates_by_name(spark):
    import pandas as pd

    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    spark.udf.register("spread_of", F.pandas_udf(spread, "double"))
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(6)], "g int, v double")
    for policy, want in (("A{spread_of>=1}", "allow"), ("A{sum>=1}", "deny"), ("A{spread_of>=3}", "deny"), ("top", "deny")):
        ctx = PolicyContext(spark)
        ctx.register("t", df, {"v": policy})
        try:
            found = ctx.sql("SELECT g, spread_of(v) AS s FROM t GROUP BY g").verdict()
        except PolicyViolation:
            found = "deny"
        assert found == want


@pytest.mark.parametrize(("policy", "text", "want"), [
    ("T{left:2}", "SELECT left(s, 2) AS x FROM t", "allow"), ("T{left:2}", "SELECT left(s, 3) AS x FROM t", "deny"), ("T{left:2}", "SELECT right(s, 2) AS x FROM t", "deny"), ("T{substring:1:2}", "SELECT substring(s, 1, 2) AS x FROM t", "allow"),
    ("top", "SELECT nvl(s, 'x') AS x FROM t", "deny"), ("A{max>=2}", "SELECT max(nvl(s, 'x')) AS x FROM t", "allow"), ("A{max>=9}", "SELECT max(nvl(s, 'x')) AS x FROM t", "deny"), ("A{max>=2}", "SELECT max(nvl2(g, s, 'x')) AS x FROM t", "allow"),
    ("A{max>=2}", "SELECT max(if(g = 0, s, NULL)) AS x FROM t WHERE g < 1", "allow"), ("A{max>=2}", "SELECT max(nvl2(nullif(g, 0), s, 'x')) AS x FROM t WHERE k < 3", "deny"), ("T{upper}", "SELECT upper(s) AS x FROM t", "allow"),
    ("T{date_add:3}", "SELECT date_add(d, 3) AS x FROM u", "allow"), ("T{date_add:3}", "SELECT date_add(d, 4) AS x FROM u", "deny"), ("T{date_format:yyyy}", "SELECT date_format(d, 'yyyy') AS x FROM u", "allow"),
])
def test_functions_by_name(spark, policy, text, want):
    ctx = PolicyContext(spark)
    ctx.register("t", spark.createDataFrame([(i, i // 2, f"abc{i}") for i in range(5)], "k int, g int, s string"), {"s": policy})
    ctx.register("u", spark.sql("SELECT date'2024-01-01' AS d"), {"d": policy})
    try:
        found = ctx.sql(text).verdict()
    except PolicyViolation:
        found = "deny"
    assert found == want


def test_release_now(spark):
    g = GuardedFrame.register(spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "k int, v int"), {"v": "A{sum>=2}"}).group_by("k").agg(s=("sum", col("v")))
    with pytest.raises(PolicyViolation, match="sum as s over too small a group"):
        g.release(now=True)
    assert g.filter(col("k") == 1).release(now=True).first().s == 5
