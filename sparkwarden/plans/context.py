"""SQL under policies: tables with policies, and queries over them whose plans are rewritten to carry these (see rewrite.py)."""

from __future__ import annotations

import contextlib
import time
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..frame import GuardedFrame
from ..noise import Budget
from ..policy import CLEAN, Duplicate, NotFound, Policy, PolicyError, PolicyViolation, parse
from ..sources import policies as files
from ..varied import ByRow
from .metrics import Step, measured
from .rewrite import Rewriter, refuse_commands


class Profile:
    """Seconds and calls by step."""

    def __init__(self) -> None:
        self.found: dict[str, list[float]] = defaultdict(lambda: [0, 0.0])

    @contextlib.contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.found[name][0] += 1
            self.found[name][1] += time.perf_counter() - began

    def report(self) -> list[tuple[str, int, float]]:
        return sorted(((k, int(n), s) for k, (n, s) in self.found.items()), key=lambda x: -x[2])


class PolicyContext:
    """Tables with policies, and SQL over them. Relations that aren't registered (views, files by path, catalog tables) are
    refused unless `allow_unregistered`; with enforce=False queries run as they are."""

    def __init__(self, spark: SparkSession, allow_unregistered: bool = False, enforce: bool = True) -> None:
        self.spark, self.allow_unregistered, self.enforce = spark, allow_unregistered, enforce
        self.frames: dict[str, GuardedFrame] = {}
        self.profile = Profile()
        self.last_error: PolicyError | None = None

    def register(
        self,
        name: str,
        df: DataFrame,
        policies: dict[str, str | Policy | ByRow] | str | None = None,
        on: list[str] | None = None,
        keys: Iterable[Iterable[str]] = (),
        missing: str = "top",
        budgets: dict[str, Budget] | None = None,
    ) -> None:
        """`policies`: by column (one for all rows, or by row); or the path of a JSON file, or of a Parquet folder whose ids go by the key
        columns `on` (without these by the rows' places). `missing`: the policy of rows that such a file leaves out. `keys`: sets of
        columns that are known to differ from row to row, so that joins on them repeat nothing."""
        with self.profile.step("register"):
            if isinstance(policies, str):
                options = {"missing": missing, "keys": keys, "budgets": budgets}
                if on:
                    f = files.read_parquet(self.spark, df, policies, on, **options)
                else:
                    f = files.read_json(df, policies, **options) if files.is_json(self.spark, policies) else files.read_dense_parquet(self.spark, df, policies, **options)
            else:
                f = GuardedFrame.register(df, {k: parse(v) if isinstance(v, str) else v for k, v in (policies or {}).items()}, keys, budgets)
            self.frames[name.lower()] = f
            df.createOrReplaceTempView(name)

    def scan(self, name: str, path: str, form: str = "parquet", options: dict[str, str] | None = None, schema: str | None = None, **rest: Any) -> None:
        """Registers files of a form that Spark reads (parquet, csv, json, orc, ...); what else register() takes comes behind."""
        with self.profile.step("scan"):
            reader = self.spark.read.format(form).options(**(options or {}))
            df = (reader.schema(schema) if schema else reader).load(path)
        self.register(name, df, **rest)

    def table(self, name: str) -> GuardedFrame:
        if name.lower() not in self.frames:
            raise NotFound(f"table {name!r}")
        return self.frames[name.lower()]

    def measure(self, text: str, enforce: bool | None = None) -> list[Step]:
        """Runs the query and tells what its operators have cost, and which of them hold tests of policies. With enforce=False
        the same without policies, to compare."""
        with self.profile.step("measure"):
            return measured(self.sql(text, enforce)._tested())

    def show_policies(self) -> dict[str, dict[str, list[str]]]:
        """Of each table the policies that cells of its columns can have."""
        return {t: f.explain_policies() for t, f in self.frames.items()}

    def sql(self, text: str, enforce: bool | None = None) -> GuardedFrame:
        """The query's rows behind their policies; raises PolicyViolation for an operation that a policy forbids."""
        try:
            with self.profile.step("parse"):
                refuse_commands(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text))
            with self.profile.step("analyse"):
                df = self.spark.sql(text)
            if not (self.enforce if enforce is None else enforce):
                return GuardedFrame(df, {c: CLEAN for c in df.columns})
            if len({c.lower() for c in df.columns}) < len(df.columns):
                raise Duplicate("columns of a guarded query need names of their own")
            with self.profile.step("check"):
                return Rewriter(self.spark, self.frames, self.allow_unregistered).rewritten(df)
        except PolicyError as e:
            self.last_error = e
            raise
