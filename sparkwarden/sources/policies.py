"""Policies in files: JSON of one policy for each cell (two shapes are read, the present one is written), and Parquet of
ids by row with a table of policies beside it."""

from __future__ import annotations

import json
import re
import uuid
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import GuardedFrame
from ..policy import BOT, CLEAN, TOP, Label, Policy, from_json, norm, parse, to_json, value
from ..varied import Varied
from .rows import positions, row_id

# Names of labels, operations and methods in the JSON shapes.
PLAIN = {"PolicyBot": BOT, "PolicyTop": TOP}
METHODS = {"Sum": "sum", "Mean": "mean", "Max": "max", "Min": "min", "First": "first", "Last": "last", "Median": "median", "NUnique": "nunique", "Implode": "implode", "Len": "len"}
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def _argument(x: Any) -> Any:
    if not isinstance(x, dict):
        return value(x)
    (name, v), *_ = x.items()
    return f"{v['secs']}s" if name == "Duration" else value(v) if isinstance(v, (int, float)) else v


def _ops(x: Any) -> list[Any]:
    return x["ops"] if isinstance(x, dict) else x


def _label(x: Any) -> Label:
    if isinstance(x, str):
        return PLAIN[x]
    (name, body), *_ = x.items()
    if name == "PolicyTransform":
        pairs = [next(iter(o.values())) for o in _ops(body)]
        several = lambda p: tuple(map(_argument, p["args"])) if "args" in p else _argument(p["arg"]) if "arg" in p else None
        return Label("T", frozenset((norm(p["name"]), several(p)) for p in pairs))
    if name == "PolicyAgg":
        how = lambda h: METHODS[h] if isinstance(h, str) else ("len" if h.get("Count", {}).get("include_nulls") else "count") if "Count" in h else "quantile"
        return Label("A", frozenset((how(o["how"]), int(o["group_size"])) for o in _ops(body)))
    if name == "PolicyNoise":
        pairs = [o["DifferentialPrivacy"] for o in _ops(body)]
        return Label("N", frozenset((float(p[0]), None if p[1] is None else float(p[1])) for p in pairs))
    raise ValueError(f"not a label: {name}")


def decode(x: Any) -> Policy:
    """A policy of either shape."""
    labels = []
    while True:
        if x == "PolicyClean" or isinstance(x, dict) and x.get("type") == "PolicyClean":
            return Policy(tuple(labels))
        body = x if x.get("type") == "PolicyDeclassify" else x["PolicyDeclassify"]
        labels.append(_label(body["label"]))
        x = body["next"]


def encode(p: Policy) -> Any:
    out: Any = "PolicyClean"
    for x in reversed(p.labels):
        ops = sorted(x.ops, key=str)
        if x.kind in ("bot", "top"):
            label: Any = "PolicyBot" if x.kind == "bot" else "PolicyTop"
        elif x.kind == "T":
            label = {"PolicyTransform": {"ops": [_transform(*o) for o in ops]}}
        elif x.kind == "A":
            named = {v: k for k, v in METHODS.items()} | {"len": {"Count": {"include_nulls": True}}, "count": {"Count": {"include_nulls": False}}}
            label = {"PolicyAgg": {"ops": [{"how": named[m], "group_size": k} for m, k in ops]}}
        else:
            label = {"PolicyNoise": {"ops": [{"DifferentialPrivacy": list(o)} for o in ops]}}
        out = {"PolicyDeclassify": {"label": label, "next": out}}
    return out


def _transform(name: str, arg: Any) -> Any:
    """Of several arguments this library's own shape, as the others stop at one."""
    if arg is None:
        return {"Unary": {"name": name}}
    if isinstance(arg, tuple):
        return {"Nary": {"name": name, "args": list(map(_written, arg))}}
    return {"Binary": {"name": name, "arg": _written(arg)}}


def _written(arg: Any) -> Any:
    if isinstance(arg, Decimal):
        return {"Float64": float(arg)}
    if m := re.fullmatch(r"(\d+)([smhd])", str(arg)):
        return {"Duration": {"secs": int(m[1]) * SECONDS[m[2]], "nanos": 0}}
    return {"String": str(arg)}


def loads(text: str) -> list[list[Policy]]:
    """For each column the policies of its rows."""
    return [[decode(p) for p in c["policies"] if p is not None] for c in json.loads(text)["columns"]] if '"policies"' in text else [[decode(p) for p in c] for c in json.loads(text)["columns"]]


def dumps(columns: list[list[Policy]]) -> str:
    return json.dumps({"columns": [{"policies": [encode(p) for p in c]} for c in columns]})


def write_parquet(ids: DataFrame, tables: dict[str, list[Policy]], path: str) -> None:
    """`ids`: key columns, and for each guarded column c the integer column c, its place in tables[c]."""
    ids.write.mode("overwrite").parquet(f"{path}/ids")
    rows = [(c, i, to_json(p)) for c, t in tables.items() for i, p in enumerate(t)]
    ids.sparkSession.createDataFrame(rows, "name string, id int, policy string").coalesce(1).write.mode("overwrite").parquet(f"{path}/table")


def read_parquet(spark: SparkSession, df: DataFrame, path: str, on: list[str], missing: str = "top", **options: Any) -> GuardedFrame:
    """`df` under the policies written at `path`, by key, once each: nulls are keys like others. A row whose key isn't there has the policy
    `missing`, and one whose key is there with several policies may not be seen at all. Other options are register()'s."""
    tables: dict[str, dict[int, Policy]] = {}
    for r in spark.read.parquet(f"{path}/table").collect():  # one row for each different policy of a column
        tables.setdefault(r["name"], {})[r["id"]] = from_json(r["policy"])
    rows = spark.read.parquet(f"{path}/ids").groupBy(*(F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(on)))
    found = rows.agg(*(F.when(F.count_distinct(c) == 1, F.min(c)).otherwise(-1).alias(f"_id_{c}") for c in tables))
    df = df.withColumn("_rid", row_id(df))
    both = df.join(found, reduce(lambda a, b: a & b, (df[f"`{k}`"].eqNullSafe(found[f"_key_{i}"]) for i, k in enumerate(on))), "left")
    return _attached(df, both, tables, missing, options)


def _attached(df: DataFrame, both: DataFrame, tables: dict[str, dict[int, Policy]], missing: str, options: dict[str, Any]) -> GuardedFrame:
    """Policies by the integers _id_<column> beside the data: -1 forbids, null is `missing`. `also` of the options: policies of other columns."""
    given = dict(options.pop("also", {}))
    for c, t in tables.items():
        n = len(t)
        pid = F.coalesce(F.when(F.col(f"_id_{c}") < 0, n + 1).otherwise(F.col(f"_id_{c}")), F.lit(n))
        given[c] = Varied(pid, (*(t[i] for i in range(n)), parse(missing), Policy((TOP,))))
    f = GuardedFrame.register(both.select(df["*"], *(f"_id_{c}" for c in tables)), given, rid="_rid", **options)
    return f.select(*(c for c in df.columns if c != "_rid"))


def write_dense(ids: DataFrame, tables: dict[str, list[Policy]], path: str) -> None:
    """`ids`: `position`, counted from 0 as the table's rows stand in its files, and for each guarded column c the integer column c."""
    write_parquet(ids, tables, path)


def read_dense(df: DataFrame, tables: dict[str, dict[int, Policy]], ids: DataFrame, missing: str = "top", **options: Any) -> GuardedFrame:
    """A scan of Parquet files under one policy for each cell, matched by the rows' places; `ids` as for write_dense."""
    placed = positions(df).withColumn("_rid", F.col("_position"))
    found = ids.groupBy(F.col("position").alias("_at")).agg(*(F.when(F.count_distinct(c) == 1, F.min(c)).otherwise(-1).alias(f"_id_{c}") for c in tables))
    both = placed.join(found, F.col("_position") == F.col("_at"), "left")
    return _attached(placed.drop("_position"), both, tables, missing, options)


def read_dense_parquet(spark: SparkSession, df: DataFrame, path: str, missing: str = "top", **options: Any) -> GuardedFrame:
    tables: dict[str, dict[int, Policy]] = {}
    for r in spark.read.parquet(f"{path}/table").collect():
        tables.setdefault(r["name"], {})[r["id"]] = from_json(r["policy"])
    return read_dense(df, tables, spark.read.parquet(f"{path}/ids"), missing, **options)


def is_json(spark: SparkSession, path: str) -> bool:
    """Whether a policy file is one JSON document, and not a folder of ids and their table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
    return not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; one of this machine only where the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        found = "/tmp/sparkwarden-shared"
    return f"{found.rstrip('/')}/policies-{uuid.uuid4().hex}"


def read_json(df: DataFrame, path: str, missing: str = "top", **options: Any) -> GuardedFrame:
    """`df` under the policies of a JSON file, one document, whose columns come in the order of df's: one policy for all rows of a
    column, or one for each; then df must be a scan of Parquet files, whose rows have places."""
    spark = df.sparkSession
    text = spark.read.text(path, wholetext=True).first()[0]
    names = json.loads(text).get("schema", df.columns)
    cells = dict(zip(names, loads(text), strict=True))
    given = {c: ps[0] if ps else CLEAN for c, ps in cells.items() if len(set(ps)) <= 1}
    dense = {c: ps for c, ps in cells.items() if c not in given}
    if not dense:
        return GuardedFrame.register(df, given, **options)
    tables = {c: list(dict.fromkeys(ps)) for c, ps in dense.items()}
    longest = max(map(len, dense.values()))
    rows = [(i, *(tables[c].index(ps[i]) if i < len(ps) else None for c, ps in dense.items())) for i in range(longest)]
    ids = spark.createDataFrame(rows, ", ".join(["position long", *(f"`{c}` int" for c in dense)]))
    return read_dense(df, {c: dict(enumerate(t)) for c, t in tables.items()}, ids, missing, also=given, **options)


# The policies of the micro benchmark, put on l_discount.
MICRO = {"a": "clean", "b": "A{max>=5}", "c": "T{+:1.0}", "d": "T{+:1.0} => A{max>=5}"}


def generate(df: DataFrame, micro: str | None = None) -> dict[str, Policy]:
    """Policies of a benchmark table: all clean, or `micro` (a text) on l_discount."""
    return {c: parse(micro) if micro and c == "l_discount" else CLEAN for c in df.columns}


def write_generated(df: DataFrame, path: str, form: str = "json", micro: str | None = None, on: list[str] | None = None) -> None:
    """The generated policies of a table as a file: one policy a column in JSON, or ids by the key columns `on` in Parquet."""
    found = generate(df, micro)
    if form == "json":
        text = json.dumps(json.loads(dumps([[p] for p in found.values()])) | {"schema": list(found)})
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif form == "parquet":
        held = {c: [p] for c, p in found.items() if p != CLEAN and c not in (on or [])}
        write_parquet(df.select(*(on or []), *(F.lit(0).alias(c) for c in held)), held, path)
    else:
        raise ValueError(f"not a form of policy files: {form}")
