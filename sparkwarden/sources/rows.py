"""Rows and their places: ids of rows, and the place of each over the Parquet files of a scan."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_files(df: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files."""
    plan = df._jdf.queryExecution().analyzed()
    name = lambda x: x.getClass().getSimpleName()
    while name(plan) in ("SubqueryAlias", "View"):
        plan = plan.children().apply(0)
    return name(plan) == "LogicalRelation" and name(plan.relation()) == "HadoopFsRelation" and name(plan.relation().fileFormat()) == "ParquetFileFormat"


def row_id(df: DataFrame) -> Column:
    """An id of each row: where it stands in its file, if it comes straight from one."""
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")) if from_files(df) else F.monotonically_increasing_id()


def positions(df: DataFrame, name: str = "_position") -> DataFrame:
    """A scan of Parquet files with the place of each row, from 0, over all files in order of their paths."""
    if not from_files(df):
        raise ValueError("only rows that come straight from Parquet files have places")
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = sorted(map(tuple, at.groupBy("_file").count().collect()))  # a row for each file
    starts = [(f, n) for (f, _), n in zip(sizes, itertools.accumulate((n for _, n in sizes), initial=0))]
    files = df.sparkSession.createDataFrame(starts, "_file string, _start long")
    return at.join(F.broadcast(files), "_file").withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")
