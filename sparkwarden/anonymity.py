"""Classes of rows that share their quasi-identifiers: k-anonymity, l-diversity and t-closeness as conditions of a release.

Each takes a GuardedFrame and gives one whose rows are in classes that are good enough. With `suppress` the rows of other classes are left
out; else they make the release an error. Where a column's policy names the condition, as T{k_anonymous:5}, T{l_diverse:3} or
T{t_close:0.2}, it is discharged. Nulls are values like others. Classes are counted by aggregates that Spark combines before it
shuffles, so none is gathered anywhere; only classes that fail are joined with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import GuardedFrame, forbidden
from .policy import Policy, T
from .varied import Varied, lift, shadow


def _held_to(f: GuardedFrame, failing: DataFrame, quasi: list[str], columns: list[str], name: str, least: float, suppress: bool) -> GuardedFrame:
    """The rows without those of failing classes; the columns' policies without this condition."""
    keys = failing.select(*(F.col(f"`{c}`").alias(f"_class_{i}") for i, c in enumerate(quasi)), F.lit(True).alias("_fails"))
    same = reduce(lambda a, b: a & b, (f._df[f"`{c}`"].eqNullSafe(keys[f"_class_{i}"]) for i, c in enumerate(quasi)))
    if suppress:
        df = f._df.join(keys, same, "left_anti")
    else:
        both = f._df.join(keys, same, "left")
        what = forbidden(f"{name} of {least:g} over {', '.join(quasi)}")
        df = both.select(*((F.when(F.col("_fails"), what).otherwise(f._df[f"`{c}`"]) if c in f.policies else f._df[f"`{c}`"]).alias(c) for c in f._df.columns))
    after = lambda p: p if p.released or p.labels[0].kind != "T" else p.downgrade(T(name, least), name)
    new = {c: lift(after, p) if c in columns else p for c, p in f.policies.items()}
    ids = {shadow(c): p.pid for c, p in new.items() if isinstance(p, Varied)}
    policies: dict[str, Policy | Varied] = {c: p.at(c) for c, p in new.items()}
    return replace(f, _df=df.withColumns(ids) if ids else df, policies=policies, _bare=None)


def k_anonymous(f: GuardedFrame, quasi: Sequence[str], k: int, suppress: bool = False) -> GuardedFrame:
    """Classes of at least k rows."""
    quasi = [f.named(c) for c in quasi]
    failing = f._df.groupBy(*(f"`{c}`" for c in quasi)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < k)
    return _held_to(f, failing, quasi, quasi, "k_anonymous", k, suppress)


def l_diverse(f: GuardedFrame, quasi: Sequence[str], sensitive: str, least: int, suppress: bool = False) -> GuardedFrame:
    """Classes with at least so many different values of a sensitive column."""
    quasi, sensitive = [f.named(c) for c in quasi], f.named(sensitive)
    values = f._df.select(*(f"`{c}`" for c in quasi), F.col(f"`{sensitive}`").alias("_v")).distinct()
    failing = values.groupBy(*(f"`{c}`" for c in quasi)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least)
    return _held_to(f, failing, quasi, [*quasi, sensitive], "l_diverse", least, suppress)


def t_close(f: GuardedFrame, quasi: Sequence[str], sensitive: str, most: float, suppress: bool = False) -> GuardedFrame:
    """Classes in which the values of a sensitive column are distributed as in all rows, but for a total variation of `most`."""
    quasi, sensitive = [f.named(c) for c in quasi], f.named(sensitive)
    keys = [F.col(f"`{c}`") for c in quasi]
    counts = f._df.groupBy(*keys, F.col(f"`{sensitive}`").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    all_ = counts.groupBy("_v").agg(F.sum("_n").alias("_all")).select(F.col("_v").alias("_w"), "_all")
    total = f._df.agg(F.count(F.lit(1)).alias("_total"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size")).select(*(c.alias(f"_s_{i}") for i, c in enumerate(keys)), "_size")
    both = counts.join(all_, F.col("_v").eqNullSafe(F.col("_w")))
    both = both.join(sizes, reduce(lambda a, b: a & b, (c.eqNullSafe(F.col(f"_s_{i}")) for i, c in enumerate(keys)))).crossJoin(F.broadcast(total))
    own, whole = F.col("_n") / F.col("_size"), F.col("_all") / F.col("_total")
    # values that a class lacks add their whole share: all shares add up to 1
    distance = (F.sum(F.abs(own - whole) - whole) + 1) / 2
    failing = both.groupBy(*keys).agg(distance.alias("_d")).where(F.col("_d") > most + 1e-9)
    return _held_to(f, failing, quasi, [*quasi, sensitive], "t_close", most, suppress)
