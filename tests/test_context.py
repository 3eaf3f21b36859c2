"""SQL under policies: verdicts of small tables, and all TPC-H queries as they are where every column is clean."""

import pytest

from sparkwarden import queries
from sparkwarden.plans.context import PolicyContext
from sparkwarden.policy import PolicyViolation

SMALL = [(2, 5), (3, 5), (3, 4), (1, 4), (5, 1)]
OFF, SUM2 = {"a": "T{dt.offset_by:5s}"}, {"a": "A{sum>=2}"}
CASES = [
    (OFF, "SELECT a, b + 1 AS b1 FROM d WHERE b > 1", "deny"),
    (OFF, "SELECT a + INTERVAL '5' SECOND AS later, b FROM d", "allow"),
    (OFF, "SELECT a + INTERVAL '4' SECOND AS later, b FROM d", "deny"),
    (OFF, "SELECT b FROM d WHERE a > TIMESTAMP '2021-01-03'", "allow"),
    (OFF, "SELECT later, sum(b) AS s FROM (SELECT a + INTERVAL '5' SECOND AS later, b FROM d) GROUP BY later", "allow"),
    (OFF, "SELECT b, year(a) AS y FROM d", "deny"),
    (OFF, "SELECT a FROM d UNION ALL SELECT a FROM d", "deny"),
    (OFF, "SELECT x.a, y.b AS c FROM d x JOIN d y ON x.a = y.a", "deny"),
    (OFF, "SELECT max(a + INTERVAL '5' SECOND) AS m, b FROM d GROUP BY b", "allow"),
    (OFF, "SELECT b, row_number() OVER (ORDER BY a) AS r FROM d", "deny"),
    (OFF, "SELECT b FROM d WHERE a = (SELECT max(a) FROM d)", "allow"),  # a predicate, like the one above
    (SUM2, "SELECT b, sum(a) AS s FROM i GROUP BY b", "deny"),
    (SUM2, "SELECT b, sum(a) AS s FROM i WHERE b > 1 GROUP BY b", "allow"),
    (SUM2, "WITH t AS (SELECT a, b FROM i WHERE b > 1) SELECT b, sum(a) AS s FROM t GROUP BY b HAVING count(*) > 1", "allow"),
    (SUM2, "SELECT sum(a) / count(*) AS m FROM i", "allow"),
    (SUM2, "SELECT avg(a) AS m FROM i", "deny"),
    (SUM2, "SELECT b, CASE WHEN b > 4 THEN a ELSE 0 END AS c FROM i", "deny"),
    ({"a": "T{+:1} => A{max>=5}"}, "SELECT max(a + 1) AS m FROM i", "allow"),
    ({"a": "T{+:1} => A{max>=5}"}, "SELECT max(a + 2) AS m FROM i", "deny"),
    ({"a": "T{+:1} => A{max>=5}"}, "SELECT b, max(a + 1) AS m FROM i GROUP BY b", "deny"),
    ({"a": "top"}, "SELECT b FROM i", "allow"),
    ({"a": "top"}, "SELECT * FROM i", "deny"),
]


@pytest.mark.parametrize(("policies", "text", "want"), CASES)
def test_verdict(spark, policies, text, want):
    ctx = PolicyContext(spark)
    ctx.register("d", spark.sql("SELECT timestamp(concat('2021-01-0', id)) AS a, CAST(id AS INT) AS b FROM range(1, 6)"), policies if policies is OFF else {})
    ctx.register("i", spark.createDataFrame(SMALL, "a int, b int"), policies if policies is not OFF else {})
    try:
        found = ctx.sql(text).verdict()
    except PolicyViolation:
        found = "deny"
    assert found == want


@pytest.mark.parametrize("name", [k for k in queries.SQL if k.startswith("tpch")])
def test_unused_columns_do_not_matter(spark, name):
    ctx = PolicyContext(spark)
    for t in queries.TABLES:
        ctx.register(t, queries.table(spark, "/root/testdata/sf0.001", t), {"l_linenumber": "top"} if t == "lineitem" else {})
    assert ctx.sql(queries.SQL[name]).release().columns == spark.sql(queries.SQL[name]).columns
