"""Command line: policy files of benchmark tables.

python -m sparkwarden.sources.generate DIR OUT [--table NAME ...] [--micro a|b|c|d] [--form json|parquet] [--on COLUMN ...]

writes OUT/<table>.policy.<form> for each table DIR/<table>.parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .policies import MICRO, write_generated

TABLES = "region nation customer supplier part orders lineitem".split()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("dir")
    p.add_argument("out")
    p.add_argument("--table", nargs="*", default=TABLES)
    p.add_argument("--micro", choices=sorted(MICRO))
    p.add_argument("--form", choices=("json", "parquet"), default="json")
    p.add_argument("--on", nargs="*", default=[])
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    for t in a.table:
        df = spark.read.parquet(f"{a.dir}/{t}.parquet")
        write_generated(df, f"{a.out}/{t}.policy.{a.form}", a.form, MICRO[a.micro] if a.micro else None, a.on)


if __name__ == "__main__":
    main()
