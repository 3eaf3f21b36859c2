"""Policies that vary by row, against the same rows under policies by column."""

import pytest
from pyspark.sql import functions as F

from sparkwarden.frame import GuardedFrame, col, when
from sparkwarden.policy import PolicyViolation, parse
from sparkwarden.varied import ByRow

ROWS = [(1, "x", 10), (1, "x", 20), (1, "y", 30), (2, "x", 40), (2, "x", 50), (3, "y", 60)]


def frame(spark, policy, rule=None):
    df = spark.createDataFrame(ROWS, "k int, g string, v int")
    return GuardedFrame.register(df, {"v": ByRow(((rule if rule is not None else F.col("g") == "x", policy),))})


def test_release(spark):
    assert frame(spark, "A{sum>=2}").verdict() == "deny"
    assert frame(spark, "A{sum>=2}", F.col("k") > 9).verdict() == "allow"
    assert frame(spark, "A{sum>=2}").filter(col("g") == "y").release().columns == ["k", "g", "v"]


def test_transform_of_some_rows(spark):
    f = frame(spark, "T{+:1}")
    assert sorted(r[0] for r in f.select(w=col("v") + 1).release().collect()) == [11, 21, 31, 41, 51, 61]
    assert f.select(w=col("v") + 2).verdict() == "deny"
    assert f.select(w=col("v") + 2, g=col("g")).filter(col("g") == "y").select("w").verdict() == "allow"
    assert f.with_columns(w=when(col("k") > 1, col("v"), 0)).select("w").verdict() == "deny"


def test_group_sizes(spark):
    by_k = lambda p, m="sum": frame(spark, p).group_by("k").agg(s=(m, col("v")))
    assert sorted(map(tuple, by_k("A{sum>=2}").release().collect())) == [(1, 60), (2, 90), (3, 60)]
    assert by_k("A{sum>=3}").verdict() == "deny"
    assert by_k("A{sum>=2}", "mean").verdict() == "deny"
    some = frame(spark, "A{sum>=3}").group_by("k").agg(True, s=("sum", col("v"))).release()
    assert sorted(map(tuple, some.collect())) == [(1, 60), (3, 60)]
    left = frame(spark, "A{sum>=2} => T{+:1}").group_by("k").agg(s=("sum", col("v")))
    assert left.verdict() == "deny" and left.filter(col("k") == 3).verdict() == "allow"
    assert sorted(r[0] for r in left.select(t=col("s") + 1).release().collect()) == [61, 61, 91]


def test_keys_distinct_union_join(spark):
    f = frame(spark, "top", F.col("k") == 3)
    assert f.group_by("v").agg(n=("len", None)).verdict() == "deny"
    assert f.filter(col("k") < 3).group_by("v").agg(n=("len", None)).verdict() == "allow"
    assert f.distinct().verdict() == "deny" and f.filter(col("k") < 3).distinct().verdict() == "allow"
    plain = GuardedFrame.register(spark.createDataFrame(ROWS, "k int, g string, v int"))
    assert f.union(plain).verdict() == "deny" and plain.union(f.filter(col("k") < 3)).release().count() == 11
    other = plain.select("k", w=col("v"))
    for how in ("inner", "left_outer", "full_outer"):
        assert f.join(other, ["k"], how).verdict() == "deny"
        assert f.filter(col("k") < 3).join(other, ["k"], how).verdict() == "allow"
    assert f.join(plain.filter(col("k") < 3).select("k"), ["k"], "left_semi").verdict() == "allow"
    assert plain.select("v").join(f.select("v"), ["v"]).verdict() == "deny"


def test_same_as_by_column(spark):
    df = spark.createDataFrame(ROWS, "k int, g string, v int")
    for policy in ("clean", "A{sum>=1}", "A{sum>=2}", "T{+:1}", "T{+:1} => A{sum>=1}", "top"):
        for make in (lambda f: f, lambda f: f.select("k", v=col("v") + 1), lambda f: f.group_by("k").agg(v=("sum", col("v"))), lambda f: f.select("k", v=col("v") + 1).group_by("k").agg(v=("sum", col("v"))), lambda f: f.select(v=col("v") * col("v"))):
            seen = []
            for given in (policy, ByRow(((F.lit(True), policy),), "bot")):
                try:
                    seen.append(make(GuardedFrame.register(df, {"v": given})).verdict())
                except PolicyViolation:
                    seen.append("deny")
            assert seen[0] == seen[1], (policy, seen)


def test_no_rows(spark):
    none = frame(spark, "top").filter(col("k") > 9)
    assert none.verdict() == "allow"
    with pytest.raises(ValueError):
        GuardedFrame.register(spark.createDataFrame(ROWS, "k int, g string, v int"), {"nothing": "top"})


def test_joins_of_many_policies(spark, monkeypatch):
    """Tables of 30 policies: all joins laid out, or the sets of groups looked up, give the same."""
    from sparkwarden import varied

    rules = tuple((F.col("v") == i, f"A{{sum>={1 + i % 3}}} => T{{+:{i % 7}}}") for i in range(30))
    df = spark.createDataFrame([(i % 4, i % 10, i) for i in range(40)], "k int, g int, v int")
    f = GuardedFrame.register(df, {"v": ByRow(rules)})
    seen = []
    for pairs in (20_000, 0):
        monkeypatch.setattr(varied, "PAIRS", pairs)
        by = lambda key: f.group_by(key).agg(s=("sum", col("v")))
        seen.append([by("k").verdict(), by("g").verdict(), by("g").select(s=col("s") + 1).verdict(), f.filter(col("v") >= 30).distinct().verdict(), f.filter(col("v") > 2).distinct().verdict()])
        seen[-1].append(f.filter(col("v") % 7 == 2).group_by("k").agg(True, s=("sum", col("v"))).select(s=col("s") + 2).verdict())
    assert seen[0] == seen[1] and set(seen[0]) == {"allow", "deny"}
    assert varied.joined(tuple(parse(f"A{{sum>={i}}}") for i in range(1, 90))) == {} and len(joined_of(90)) == 91


def joined_of(n):
    from sparkwarden import varied

    varied.PAIRS = 20_000
    return varied.joined(tuple(parse(f"A{{sum>={i}}}") for i in range(1, n + 1)))
