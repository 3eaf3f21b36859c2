import json

import pytest

from sparkwarden import queries
from sparkwarden.frame import GuardedFrame, col
from sparkwarden.policy import CLEAN, parse
from sparkwarden.sources import policies as files

OLD = {"schema": ["a", "b"], "columns": [{"policies": [{"type": "PolicyDeclassify", "label": {"PolicyTransform": {"ops": [{"Binary": {"name": "dt.offset_by", "arg": {"Duration": {"secs": 5, "nanos": 0}}}}]}}, "next": {"type": "PolicyClean"}}]}, {"policies": [{"type": "PolicyClean"}]}]}
NEW = {"columns": [{"policies": [{"PolicyDeclassify": {"label": {"PolicyAgg": {"ops": [{"how": "Sum", "group_size": 2}]}}, "next": "PolicyClean"}}, "PolicyClean"]}]}


def test_both_shapes():
    assert files.loads(json.dumps(OLD)) == [[parse("T{dt.offset_by:5s}")], [CLEAN]]
    assert files.loads(json.dumps(NEW)) == [[parse("A{sum>=2}"), CLEAN]]
    assert json.loads(files.dumps(files.loads(json.dumps(NEW)))) == NEW


@pytest.mark.parametrize("text", ["clean", "bot", "top", "T{dt.offset_by:5s} => bot", "T{+:1} => A{max>=5}", "A{sum>=2, len>=3}", "N{0.5,0.01}", "T{redact}"])
def test_round_trip(text):
    chain = "T{+:1} => A{max>=5}" if text.startswith("T{+") else text
    assert files.loads(files.dumps([[parse(chain), CLEAN]])) == [[parse(chain), CLEAN]]


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, i) for i in range(9)], "id int, k int, v int")
    files.write_parquet(df.where("id < 8").selectExpr("id", "CAST(k = 0 AS INT) AS v"), {"v": [CLEAN, parse("A{sum>=3}")]}, f"{tmp_path}/p")
    closed = files.read_parquet(spark, df, f"{tmp_path}/p", ["id"])
    assert closed.filter(col("k") > 0).filter(col("id") < 8).verdict() == "allow" and closed.filter(col("id") == 8).verdict() == "deny"
    g = files.read_parquet(spark, df, f"{tmp_path}/p", ["id"], missing="clean")
    assert g.verdict() == "deny"
    assert g.filter(col("k") > 0).release().count() == 6 and g.filter(col("id") == 8).verdict() == "allow"
    assert g.group_by("k").agg(s=("sum", col("v"))).verdict() == "allow"
    assert g.group_by("id").agg(s=("sum", col("v"))).verdict() == "deny"


def test_generated(spark):
    df = queries.table(spark, "/root/testdata/sf0.001", "lineitem")
    assert GuardedFrame.register(df, files.generate(df)).verdict() == "allow"
    assert GuardedFrame.register(df, files.generate(df, queries.MICRO["b"])).verdict() == "deny"
