"""GuardedFrame: a DataFrame of which each column has a policy, checked operator by operator.

Policies of columns are settled on the driver while the plan is built, without touching data. What depends on data becomes a part of
the plan itself: an aggregate under a least group size, and a cell whose policy varies by row (ByRow), stand behind a test that
raises an error where the rows break the policy. So a query is run once, and a value that may not be seen is never computed for
anyone; release() returns the plain DataFrame or raises PolicyViolation for what the plan alone shows, verdict() runs the tests.

A group's size is the number of registered rows of which a cell reaches the aggregate. Where a join or a union may have
repeated rows their ids are counted, each once: ids are laid beside the data at registration and dropped by Spark where
nothing counts them. A join on a declared key of the other side repeats nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .noise import Budget, laplace_of
from .policy import A, CLEAN, Duplicate, N, NotFound, Policy, PolicyViolation, T, norm, parse
from .sources.rows import positions, row_id
from .varied import ByRow, Varied, any_of, chosen, lift, merged, shadow, worst

#: What the errors of tests in a plan begin with.
MARK = "forbidden by a policy: "
NUMBERS = itertools.count()
#: Logarithm of the entries that a sketch of row ids may have.
MOST_ENTRIES = 20

ARITHMETIC = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "mod": lambda a, b: a % b, "pow": F.pow}
COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b}


def least_of(c: Column, real: bool) -> Column:
    """Spark's min takes NaN as the largest number and so passes it over; here a NaN in a group is its least."""
    return F.when(F.max(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c)) if real else F.min(c)


def no_nan(c: Column, real: bool) -> Column:
    return F.when(~F.isnan(c), c) if real else c


def quantile(c: Column, q: float, how: str = "linear") -> Column:
    """Exact; between two values `how` is linear, lower, higher, midpoint or nearest (half to the even place)."""
    if how == "linear":
        return F.percentile(c, F.lit(q))
    sorted_ = F.array_sort(F.collect_list(c))
    at = (F.size(sorted_) - 1) * F.lit(q)
    lo, hi = F.get(sorted_, F.floor(at).cast("int")), F.get(sorted_, F.ceil(at).cast("int"))
    return {"lower": lo, "higher": hi, "midpoint": (lo + hi) / 2, "nearest": F.get(sorted_, F.bround(at).cast("int"))}[how]


#: method -> aggregate of (column, whether it has NaNs, parameters).
AGGREGATES: dict[str, Callable[..., Column]] = {
    "sum": lambda c, _: F.sum(c), "mean": lambda c, _: F.avg(c), "max": lambda c, _: F.max(c), "min": least_of, "len": lambda c, _: F.count(c), "count": lambda c, _: F.count(c),
    "nanmin": lambda c, real: F.min(no_nan(c, real)), "nanmax": lambda c, real: F.max(no_nan(c, real)), "median": lambda c, _: F.median(c), "nunique": lambda c, _: F.count_distinct(c),
    "std": lambda c, _, ddof=1: (F.stddev_samp if ddof else F.stddev_pop)(c), "var": lambda c, _, ddof=1: (F.var_samp if ddof else F.var_pop)(c), "quantile": lambda c, _, q, how="linear": quantile(c, q, how),
    "implode": lambda c, _: F.collect_list(c), "groups": lambda c, _: F.array_sort(F.collect_list(c)),  # of the rows' places, see indexed()
}


def aggregate(method: str, c: Column, real: bool, where: Column | None, *args: Any) -> Column:
    """The aggregate of a method; first and last need the name of an ordering column."""
    only = (lambda x: x) if where is None else (lambda x: F.when(where, x))
    if method in ("first", "last"):
        if not args:
            raise ValueError(f"{method} needs the column by which rows are ordered")
        order = only(F.col(f"`{args[0]}`"))
        return F.min_by(c, order) if method == "first" else F.max_by(c, order)
    return AGGREGATES[method](only(c), real, *args)


@dataclass(frozen=True)
class Expr:
    """A Spark column and the policy of its cells, given those of the frame's columns."""

    build: Callable[[GuardedFrame], tuple[Column, Policy | Varied]]
    literal: Any = None
    is_literal: bool = False
    bounds: tuple[float, float] | None = None

    def _arith(self, other: Any, name: str) -> Expr:
        a, b = self, as_expr(other)

        def build(f: GuardedFrame) -> tuple[Column, Policy | Varied]:
            (ca, pa, la), (cb, pb, lb) = f.part(a), f.part(b)
            f.apart(la, lb)
            given = lambda e: e.literal if e.is_literal else object()

            def after(p: Policy, q: Policy) -> Policy:
                if p.released and q.released:
                    return CLEAN
                if p.released or q.released:
                    return q.downgrade(T(name, given(a)), name) if p.released else p.downgrade(T(name, given(b)), name)
                return p.join(q)

            return ARITHMETIC[name](ca, cb), lift(after, pa, pb)

        return Expr(build)

    def _compare(self, other: Any, name: str) -> Expr:
        a, b = self, as_expr(other)

        def build(f: GuardedFrame) -> tuple[Column, Policy | Varied]:
            (ca, pa, la), (cb, pb, lb) = f.part(a), f.part(b)
            f.apart(la, lb)
            return COMPARE[name](ca, cb), lift(Policy.join, pa, pb)

        return Expr(build)

    __add__ = lambda s, o: s._arith(o, "add")
    __sub__ = lambda s, o: s._arith(o, "sub")
    __mul__ = lambda s, o: s._arith(o, "mul")
    __truediv__ = lambda s, o: s._arith(o, "div")
    __mod__ = lambda s, o: s._arith(o, "mod")
    __pow__ = lambda s, o: s._arith(o, "pow")
    __rsub__ = lambda s, o: as_expr(o)._arith(s, "sub")
    __radd__ = lambda s, o: as_expr(o)._arith(s, "add")
    __rmul__ = lambda s, o: as_expr(o)._arith(s, "mul")
    __lt__ = lambda s, o: s._compare(o, "<")
    __le__ = lambda s, o: s._compare(o, "<=")
    __gt__ = lambda s, o: s._compare(o, ">")
    __ge__ = lambda s, o: s._compare(o, ">=")
    __and__ = lambda s, o: s._compare(o, "and")
    __or__ = lambda s, o: s._compare(o, "or")

    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return self._compare(other, "=")

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return self._compare(other, "!=")

    def apply(self, name: str, fn: Callable[..., Column], *args: Any) -> Expr:
        """A function of this column known by its name and literal arguments, all of which its label must name."""
        plain(*args)

        def build(f: GuardedFrame) -> tuple[Column, Policy | Varied]:
            c, p = self.build(f)
            return fn(c, *args), lift(lambda p: p.downgrade(T(name, *args), name), p)

        return Expr(build)

    def _test(self, of: Callable[[Column], Column]) -> Expr:
        """A predicate: its cells have the policy of what it looks at, like comparisons."""
        return Expr(lambda f: (lambda c, p: (of(c), p))(*self.build(f)))

    __invert__ = lambda s: s._test(lambda c: ~c)
    __neg__ = lambda s: s.apply("neg", lambda c: -c)
    is_null = lambda s: s._test(lambda c: c.isNull())
    is_in = lambda s, *xs: plain(*xs) and s._test(lambda c: c.isin(*xs))
    between = lambda s, a, b: plain(a, b) and s._test(lambda c: c.between(a, b))
    like = lambda s, pattern: plain(pattern) and s._test(lambda c: c.like(pattern))
    contains = lambda s, pattern: plain(pattern) and s._test(lambda c: c.rlike(pattern))
    starts_with = lambda s, x: plain(x) and s._test(lambda c: c.startswith(x))
    ends_with = lambda s, x: plain(x) and s._test(lambda c: c.endswith(x))
    year = lambda s: s.apply("year", F.year)
    round = lambda s, n=0: s.apply("round", lambda c, n: F.round(c, n), n)
    substring = lambda s, at, n: s.apply("substring", lambda c, a, n: F.substring(c, a, n), at, n)
    regexp_replace = lambda s, pattern, by: s.apply("regexp_replace", F.regexp_replace, pattern, by)
    redact = lambda s, by="*": s.apply("redact", lambda c: F.when(c.isNotNull(), F.lit(by)))
    identity = lambda s: s.apply("identity", lambda c: c)

    def clip(self, low: float, high: float) -> Expr:
        """Values between two bounds; the policy stays, and noise knows what one cell can change."""
        plain(low, high)
        if not low < high:
            raise ValueError("bounds that leave no room")
        made = self._test(lambda c: F.least(F.greatest(c, F.lit(low)), F.lit(high)))
        return replace(made, bounds=(float(low), float(high)))

    def laplace(self, epsilon: float, sensitivity: float | None = None) -> Expr:
        """With Laplace noise of scale sensitivity / epsilon, which discharges N labels of this epsilon or a larger one, and takes
        epsilon from the budgets of the columns that it reads each time it is released. Sensitivity: the width between clip()'s bounds, if not given."""
        if sensitivity is None:
            if self.bounds is None:
                raise ValueError("noise needs clip() or a sensitivity")
            sensitivity = self.bounds[1] - self.bounds[0]
        noise = laplace_of(epsilon, sensitivity)

        def build(f: GuardedFrame) -> tuple[Column, Policy | Varied]:
            c, p = f.noting(self, epsilon)
            return c + noise, lift(lambda p: p.downgrade(N(epsilon), "laplace"), p)

        return Expr(build)

    def cast(self, kind: str) -> Expr:
        return Expr(lambda f: (lambda c, p: (c.cast(kind), p))(*self.build(f)))


def plain(*xs: Any) -> bool:
    """Refuses Spark's Columns where only values are meant: they could read any cell, whatever its policy."""
    if any(isinstance(x, Column) or isinstance(x, (list, tuple, set)) and not plain(*x) for x in xs):
        raise TypeError("a Column isn't a value: use col() and the expressions of this module")
    return True


def col(name: str) -> Expr:
    return Expr(lambda f: f.cell(name))


def lit(x: Any) -> Expr:
    plain(x)
    return Expr(lambda f: (F.lit(x), CLEAN), x, True)


def as_expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else lit(x)


def when(cond: Expr, yes: Any, no: Any) -> Expr:
    """Each row has the policy of the arm that it takes. Under an aggregate with a least group size only the rows that
    take a protected arm count, so that a condition can't single out a row; what is to be aggregated may read a column in one arm only."""

    yes, no = as_expr(yes), as_expr(no)

    def build(f: GuardedFrame) -> tuple[Column, Policy | Varied]:
        c = cond.build(replace(f, _log=Log()))[0]
        (a, pa, la), (b, pb, lb) = f.part(yes), f.part(no)
        if f.reads(la) & f.reads(lb):
            raise PolicyViolation("cells of one table through arms that differ")
        f._log.picked |= f.reads(la) | f.reads(lb)
        return F.when(c, a).otherwise(b), chosen(c, pa, pb)

    return Expr(build)


def function(name: str, *args: Any) -> Expr:
    """A built-in function of values: its cells are clean."""
    plain(*args)
    return Expr(lambda f: (F.call_function(name, *map(F.lit, args)), CLEAN))


def offset_by(e: Expr, duration: str) -> Expr:
    return e.apply("dt.offset_by", lambda c, d: c + F.expr(f"INTERVAL {d[:-1]} {dict(s='SECOND', m='MINUTE', h='HOUR', d='DAY')[d[-1]]}"), duration)


@dataclass
class Log:
    """What building an expression has read: columns, and the noise drawn from budgets."""

    names: set[str] = field(default_factory=set)
    #: Row ids of cells that only some rows read.
    picked: set[str] = field(default_factory=set)
    spent: list[tuple[Budget, float]] = field(default_factory=list)


@dataclass(frozen=True)
class Made:
    """A built expression: its column, policy, the row ids and budgets of the cells that it reads, and what noise has cost."""

    column: Column
    policy: Policy | Varied
    origin: frozenset[str]
    budgets: frozenset[Budget]
    spent: tuple[tuple[Budget, float], ...]
    names: frozenset[str]
    picked: frozenset[str]


def forbidden(what: str) -> Column:
    return F.raise_error(F.lit(MARK + what))


#: Of an aggregate: a test of rows with a protected cell, one of the rows that count with them, their id where they may be repeated, and the
#: least number of these. None stands for all rows, and for the same test.
Size = tuple[Column | None, Column | None, Column | None, int]


def sized(value: Column, small: Column, what: str) -> Column:
    """The value, or an error where its group is too small."""
    return F.when(small, forbidden(what)).otherwise(value)


def different(rid: Column, k: int) -> Column:
    """How many different ids there are, exactly below k, and k at least from there on: no more of them are kept, so that rows which a join repeats
    aren't sent to be told apart. A theta sketch is exact up to its nominal entries and keeps as many beyond them."""
    if k <= 2:
        return F.when(F.min(rid) < F.max(rid), 2).when(F.max(rid).isNotNull(), 1).otherwise(0)
    lg = max(4, k.bit_length())
    return F.theta_sketch_estimate(F.theta_sketch_agg(rid, lg)) if lg <= MOST_ENTRIES else F.count_distinct(rid)


def too_small(sizes: list[Size]) -> Column:
    """Whether any of the sizes is short of its least. A group without protected cells discloses none."""
    tests = []
    for any_, counted, rid, k in sizes:
        of = any_ if counted is None else counted
        if rid is None:
            n = F.count(F.lit(1)) if of is None else F.count_if(of)
        else:
            n = different(rid if of is None else F.when(of, rid), k)
        tests.append(n.between(1, k - 1) if counted is None else (F.count_if(any_) > 0) & (n < k))
    return reduce(lambda a, b: a | b, tests)


@dataclass(frozen=True)
class GuardedFrame:
    _df: DataFrame
    policies: dict[str, Policy | Varied]
    #: The row ids (columns beside the data) of what the cells of each column come from.
    _origin: dict[str, frozenset[str]] = field(default_factory=dict)
    #: Row ids that may stand in several rows.
    _repeated: frozenset[str] = frozenset()
    #: Sets of columns that no two rows share.
    _unique: frozenset[frozenset[str]] = frozenset()
    #: Row ids of cells that only some rows of a column have.
    _picked: dict[str, frozenset[str]] = field(default_factory=dict)
    _budgets: dict[str, frozenset[Budget]] = field(default_factory=dict)
    _spent: tuple[tuple[Budget, float], ...] = ()
    _log: Log = field(default_factory=Log)
    #: The data as registered, without row ids, for queries that don't count them.
    _bare: DataFrame | None = None

    @staticmethod
    def register(
        df: DataFrame,
        policies: dict[str, str | Policy | ByRow | Varied] | None = None,
        keys: Iterable[Iterable[str]] = (),
        budgets: dict[str, Budget] | None = None,
        rid: str | None = None,
    ) -> GuardedFrame:
        """`keys`: sets of columns that are known to differ from row to row. `budgets`: what noise may cost, by column. `rid`: a column of
        df that tells its rows apart; it isn't among the frame's."""
        given = {k: parse(v) if isinstance(v, str) else v for k, v in (policies or {}).items()}
        if unknown := (given.keys() | (budgets or {}).keys() | {c for k in keys for c in k}) - set(df.columns):
            raise ValueError(f"no such columns: {sorted(unknown)}")
        if len({c.lower() for c in df.columns}) < len(df.columns):
            raise Duplicate("columns need names that differ in more than case")
        f = GuardedFrame(df, {c: CLEAN for c in df.columns if c != rid}, _unique=frozenset(map(frozenset, keys)))
        f = replace(f, _budgets={c: frozenset([b]) for c, b in (budgets or {}).items()})
        known = {c: p.varied() if isinstance(p, ByRow) else p for c, p in given.items()}
        counted = [c for c, p in known.items() if any(x.kind == "A" for q in (p.table if isinstance(p, Varied) else (p,)) for x in q.labels)]
        if counted:
            own = f"_rid_{next(NUMBERS)}"
            f = replace(f, _df=df.withColumn(own, row_id(df) if rid is None else F.col(rid)), _origin={c: frozenset([own]) for c in counted})
        ids = {shadow(c): p.pid for c, p in known.items() if isinstance(p, Varied)}
        with_ids = lambda d: d.withColumns(ids) if ids else d
        return replace(f, _df=with_ids(f._df), _bare=with_ids(df) if counted and rid is None else None, policies=f.policies | {c: p.at(c) for c, p in known.items()})

    @staticmethod
    def indexed(df: DataFrame, policies: dict[str, str | Policy | ByRow | Varied] | None = None, row: str = "row", **options: Any) -> GuardedFrame:
        """register(), with a column of the rows' places in their Parquet files, which go along with the rows: `groups` of it gives the
        rows of each group, and group() of a key those of one."""
        return GuardedFrame.register(positions(df, row), policies, rid=None, **options)

    def named(self, name: str) -> str:
        """The column that the session takes a name for."""
        if name in self.policies:
            return name
        found = {c.lower(): c for c in self.policies}.get(name.lower())
        if found is None or self._df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
            raise NotFound(f"column {name!r}")
        return found

    def cell(self, name: str) -> tuple[Column, Policy | Varied]:
        name = self.named(name)
        self._log.names.add(name)
        self._log.picked |= self._picked.get(name, frozenset())
        return F.col(f"`{name}`"), self.policies[name]

    def noting(self, e: Expr, epsilon: float) -> tuple[Column, Policy | Varied]:
        """An expression's column and policy; epsilon is noted against the budgets of what it reads."""
        m = self.made(e)
        self._log.names |= m.names
        self._log.picked |= m.picked
        self._log.spent += [*m.spent, *((b, epsilon) for b in m.budgets)]
        return m.column, m.policy

    def made(self, e: Any) -> Made:
        f = replace(self, _log=Log())
        c, p = as_expr(e).build(f)
        of = lambda known: frozenset().union(*(known.get(n, frozenset()) for n in f._log.names))
        return Made(c, p, of(self._origin), of(self._budgets), tuple(f._log.spent), frozenset(f._log.names), frozenset(f._log.picked))

    def part(self, e: Expr) -> tuple[Column, Policy | Varied, Log]:
        """A part of an expression, and what it alone has read."""
        log = Log()
        c, p = e.build(replace(self, _log=log))
        self._log.names |= log.names
        self._log.picked |= log.picked
        self._log.spent += log.spent
        return c, p, log

    def reads(self, log: Log) -> frozenset[str]:
        """Row ids of the cells read that ask for a group size."""
        tables = {n: p.table if isinstance(p, Varied) else (p,) for n, p in ((n, self.policies[n]) for n in log.names)}
        asked = [n for n, t in tables.items() if any(x.kind == "A" for p in t for x in p.labels)]
        return frozenset().union(*(self._origin.get(n, frozenset()) for n in asked))

    def apart(self, a: Log, b: Log) -> None:
        if self.reads(a) & b.picked or self.reads(b) & a.picked:
            raise PolicyViolation("cells of one table through arms that differ")

    def _ids(self) -> list[str]:
        """Row ids that columns still need."""
        return sorted(frozenset().union(*self._origin.values()) & set(self._df.columns))

    def _taken(self, df: DataFrame, made: dict[str, Made], kept: Iterable[str], unique: frozenset[frozenset[str]]) -> GuardedFrame:
        """`df` with columns `made`, and those of `kept` that aren't among them as they are."""
        kept = list(kept)
        of = lambda known, name: {c: known[c] for c in kept if c in known} | {n: getattr(m, name) for n, m in made.items()}
        spent = tuple(x for m in made.values() for x in m.spent)
        policies = {c: self.policies[c] for c in kept} | {n: m.policy.at(n) for n, m in made.items()}
        return GuardedFrame(df, policies, of(self._origin, "origin"), self._repeated, unique, of(self._picked, "picked"), of(self._budgets, "budgets"), (*self._spent, *spent))

    def filter(self, cond: Expr) -> GuardedFrame:
        return replace(self, _df=self._df.where(cond.build(replace(self, _log=Log()))[0]), _bare=None)

    def select(self, *names: str, **exprs: Expr) -> GuardedFrame:
        """Columns by name ("*" for all), and made ones."""
        names = tuple(c for n in names for c in (self.policies if n == "*" else (n,)))
        made = {self.named(n): self.made(col(n)) for n in names} | {n: self.made(e) for n, e in exprs.items()}
        if len({n.lower() for n in made}) < len(made):
            raise Duplicate("columns need names that differ in more than case")
        ids = [m.policy.pid.alias(shadow(n)) for n, m in made.items() if isinstance(m.policy, Varied)]
        rids = sorted(frozenset().union(*(m.origin for m in made.values())) & set(self._df.columns))
        df = self._df.select(*(m.column.alias(n) for n, m in made.items()), *ids, *rids)
        stay = frozenset(k for k in self._unique if all(c in names and c not in exprs for c in k))
        return self._taken(df, made, (), stay)

    def with_columns(self, **exprs: Expr) -> GuardedFrame:
        """A name that the session takes for that of a column replaces it."""
        known = {n: next((c for c in self.policies if c.lower() == n.lower()), n) for n in exprs}
        made = {known[n]: self.made(e) for n, e in exprs.items()}
        ids = {shadow(n): m.policy.pid for n, m in made.items() if isinstance(m.policy, Varied)}
        df = self._df.withColumns({n: m.column for n, m in made.items()} | ids)
        return self._taken(df, made, list(self.policies), frozenset(k for k in self._unique if not k & made.keys()))

    def join(self, other: GuardedFrame, on: list[str], how: str = "inner") -> GuardedFrame:
        """Cells that an outer join fills with null are clean; a key has the policies of both sides."""
        on = [self.named(c) for c in on]
        if unknown := set(on) - set(other.policies):
            raise ValueError(f"keys {sorted(unknown)} need the same names on both sides")
        if (set(self.policies) & set(other.policies)) - set(on):
            raise Duplicate("columns need names of their own")
        spent = (*self._spent, *other._spent)
        if how in ("left_semi", "left_anti"):
            right = other._df.select(*(f"`{c}`" for c in on))
            keys = {c: replace(self.made(col(c)), policy=lift(Policy.join, self.policies[c], worst(other.policies[c]))) for c in on}
            df = self._df.join(right, on, how)
            ids = {shadow(c): m.policy.pid for c, m in keys.items() if isinstance(m.policy, Varied)}
            return replace(self._taken(df.withColumns(ids) if ids else df, keys, list(self.policies), self._unique), _spent=spent)
        other = other._renamed(set(self._df.columns))
        key_ids = {c: F.col(f"`{shadow(c)}`").alias(f"_right{shadow(c)}") for c, p in other.policies.items() if c in on and isinstance(p, Varied)}
        df = self._df.join(other._df.select("*", *key_ids.values()).drop(*(shadow(c) for c in key_ids)), on, how)
        policies = {c: (p.padded() if isinstance(p, Varied) else p) for c, p in (other.policies | self.policies).items()}
        right = {c: (Varied(F.col(f"`_right{shadow(c)}`"), other.policies[c].table).padded() if c in key_ids else other.policies[c]) for c in on}
        policies |= {c: lift(Policy.join, policies[c], right[c]) for c in on}
        ids = {shadow(c): p.pid for c, p in policies.items() if isinstance(p, Varied)}
        both = lambda a, b: {c: a.get(c, frozenset()) | b.get(c, frozenset()) for c in a.keys() | b.keys()}
        single = lambda f: any(k <= set(on) for k in f._unique)
        # rows that a join makes up for those without a partner have no cells to count either
        stays = lambda f, sides: single(f) and how not in sides
        repeated = self._repeated | (frozenset() if stays(other, ("right", "right_outer", "full", "full_outer", "outer")) else frozenset(self._ids()))
        repeated |= other._repeated | (frozenset() if stays(self, ("left", "left_outer", "full", "full_outer", "outer")) else frozenset(other._ids()))
        unique = (self._unique if single(other) else frozenset()) | (other._unique if single(self) else frozenset())
        unique = frozenset(k for k in unique if how == "inner" or k <= set(on))
        out = GuardedFrame(df.withColumns(ids) if ids else df, {c: p.at(c) for c, p in policies.items()}, both(self._origin, other._origin), repeated, unique)
        return replace(out, _picked=both(self._picked, other._picked), _budgets=both(self._budgets, other._budgets), _spent=spent)

    def _renamed(self, taken: set[str]) -> GuardedFrame:
        """With row ids whose names aren't taken, as in a join of a frame with itself."""
        new = {r: f"_rid_{next(NUMBERS)}" for r in self._df.columns if r.startswith("_rid_") and r in taken}
        if not new:
            return self
        of = lambda rids: frozenset(new.get(r, r) for r in rids)
        each = lambda known: {c: of(r) for c, r in known.items()}
        return replace(self, _df=self._df.withColumnsRenamed(new), _origin=each(self._origin), _picked=each(self._picked), _repeated=of(self._repeated))

    def union(self, other: GuardedFrame) -> GuardedFrame:
        """Where a column's policy varies by row on either side, each row keeps its own. The same row may come from both sides."""
        both = {c: merged(p, other.policies[c]) for c, p in self.policies.items()}
        origin, ids = {}, {}
        for c in both:
            sides = sorted(self._origin.get(c, ())), sorted(other._origin.get(c, ()))
            for a, b in itertools.zip_longest(*sides):
                ids.setdefault((a, b), f"_rid_{next(NUMBERS)}")
                origin[c] = origin.get(c, frozenset()) | {ids[a, b]}
        frames = []
        for k, f in enumerate((self, other)):
            rids = [(F.lit(None).cast("long") if pair[k] is None else F.col(pair[k])).alias(n) for pair, n in ids.items()]
            frames.append(f._df.select(*(F.col(f"`{c}`") for c in both), *(m[k].pid.alias(shadow(c)) for c, m in both.items() if isinstance(m[k], Varied)), *rids))
        budgets = {c: self._budgets.get(c, frozenset()) | other._budgets.get(c, frozenset()) for c in both}
        policies = {c: m[0].at(c) for c, m in both.items()}
        picked = {c: origin.get(c, frozenset()) for c in both if self._picked.get(c) or other._picked.get(c)}
        df = frames[0].unionByName(frames[1])
        return GuardedFrame(df, policies, origin, frozenset(ids.values()), frozenset(), picked, budgets, (*self._spent, *other._spent))

    def distinct(self) -> GuardedFrame:
        """Equal rows as one, which counts as one of those that it stands for."""
        groups = self._df.groupBy(*(f"`{c}`" for c in self.policies))
        varied = {c: any_of(p, lambda k: looked_up(groups, k)) for c, p in self.policies.items() if isinstance(p, Varied)}
        kept = [*(m.pid.alias(shadow(c)) for c, m in varied.items()), *(F.min(r).alias(r) for r in self._ids())]
        df = groups.agg(*kept) if kept else self._df.select(*(f"`{c}`" for c in self.policies)).distinct()
        unique = self._unique | {frozenset(self.policies)}
        return replace(self, _df=df, policies=self.policies | {c: m.at(c) for c, m in varied.items()}, _unique=unique, _bare=None)

    def sort(self, *by: Any) -> GuardedFrame:
        return replace(self, _df=self._df.orderBy(*by), _bare=None)

    def limit(self, n: int) -> GuardedFrame:
        return replace(self, _df=self._df.limit(n), _bare=None)

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(self, tuple(map(self.named, keys)))

    def agg(self, suppress: bool = False, **aggs: tuple[str, Expr | None]) -> GuardedFrame:
        return Grouped(self, ()).agg(suppress, **aggs)

    def test(self) -> None:
        """Runs the plan with its tests, without keeping rows; raises PolicyViolation where they break a policy."""
        try:
            self._tested().write.format("noop").mode("overwrite").save()
        except PolicyViolation:
            raise
        except Exception as e:
            if MARK in str(e):
                raise PolicyViolation(str(e).split(MARK)[1].split("\n")[0].split(". SQLSTATE")[0]) from None
            raise

    def verdict(self) -> str:
        """Whether the rows may be released, found by running the tests."""
        try:
            self.test()
            return "allow"
        except PolicyViolation:
            return "deny"

    def sample(self, fraction: float, seed: int | None = None) -> GuardedFrame:
        return replace(self, _df=self._df.sample(fraction, seed), _bare=None)

    def group(self, **key: Any) -> GuardedFrame:
        """The rows of one group: those whose key columns have these values."""
        plain(*key.values())
        tests = (F.col(f"`{self.named(c)}`").eqNullSafe(F.lit(v)) for c, v in key.items())
        return replace(self, _df=self._df.where(reduce(lambda a, b: a & b, tests, F.lit(True))), _bare=None)

    def explain(self, mode: str = "formatted") -> None:
        """Spark's plan and the columns' policies; no rows."""
        self._df.explain(mode)
        print("\n".join(f"{c}: {' | '.join(p)}" for c, p in self.explain_policies().items()))

    def explain_policies(self) -> dict[str, list[str]]:
        """The policies that cells of each column can have."""
        return {c: list(map(str, p.table if isinstance(p, Varied) else (p,))) for c, p in self.policies.items()}

    def policy_cells(self, n: int = 15) -> DataFrame:
        """The policies of the cells of the first n rows, in the cells' places; no cell is read."""
        return self._df.limit(n).select(*((p.text() if isinstance(p, Varied) else F.lit(str(p))).alias(c) for c, p in self.policies.items()))

    def _tested(self) -> DataFrame:
        """The data behind the tests of cells whose policies vary by row."""
        out = []
        for c, p in self.policies.items():
            value = F.col(f"`{c}`")
            if isinstance(p, Varied):
                for i in p.held():
                    value = F.when(p.pid == i, forbidden(f"release on column {c!r}: {p.table[i]}")).otherwise(value)
            elif not p.released:
                raise PolicyViolation("release", c, p)
            out.append(value.alias(c))
        return self._df.select(*out)

    def release(self, now: bool = False) -> DataFrame:
        """The data, if every cell may be seen. Tests that need data are part of its plan, and raise an error when it runs; with `now` they
        are run here first, as PolicyViolation. What noise costs is taken from its budgets."""
        df = self._tested()
        if now:
            self.test()
        Budget.charge_all(self._spent)
        return df


def looked_up(groups: Any, key: Column) -> list[str]:
    """The different values of an aggregate over the groups."""
    return [r[0] for r in groups.agg(key.alias("_found")).select("_found").distinct().collect()]


@dataclass(frozen=True)
class Grouped:
    frame: GuardedFrame
    keys: tuple[str, ...]

    def agg(self, suppress: bool = False, **aggs: tuple) -> GuardedFrame:
        """name=(method, expression, parameters..., filter): first and last take the name of an ordering column, std and var a ddof,
        quantile its q and interpolation, laplace_sum and laplace_count an epsilon; an expression behind these filters the rows that are
        aggregated, and those that pass are the group whose size counts. With `suppress` groups that are too small are left out
        instead of forbidding all.

        A key has the policies of all its cells in the group; so has what is left of those of an aggregated expression."""
        f, out, short = self.frame, [], []
        groups = f._df.groupBy(*(f"`{k}`" for k in self.keys))
        look = lambda k: looked_up(groups, k)
        made = {k: f.made(col(k)) for k in self.keys}
        made = {k: replace(m, policy=any_of(m.policy, look) if isinstance(m.policy, Varied) else m.policy) for k, m in made.items()}
        for name, (method, e, *args) in aggs.items():
            where = f.made(args.pop()).column if args and isinstance(args[-1], Expr) else None
            m = f.made(e) if e is not None else f.made(lit(1))
            c, p = m.column, m.policy
            real = method in ("min", "nanmin", "nanmax") and f._df.select(c).schema[0].dataType.simpleString() in ("float", "double")
            least = lambda p: dict(p.labels[0].ops).get(norm(method), 0) if p.labels and p.labels[0].kind == "A" else 0  # noqa: B023, E731
            passed = None if where is None else F.coalesce(where, F.lit(False))
            if method in ("laplace_sum", "laplace_count"):
                value, after, spent = noisy(method, e, c, p, F.lit(True) if passed is None else passed, *args)
                m = replace(m, spent=(*m.spent, *((b, spent) for b in m.budgets)))
            else:
                value = aggregate(method, F.lit(1) if method == "len" else c, real, where, *args)
                after = lift(lambda p: p.downgrade(A(method, k=least(p)), method), p)  # noqa: B023
            rids = sorted(m.origin & f._repeated) or [None]
            if not p.released and any(r is not None and r not in f._df.columns for r in rids):
                raise PolicyViolation("aggregation of rows that a join may repeat and that have no id")
            sizes: list[Size] = []
            for i, q in enumerate(p.table if isinstance(p, Varied) else (p,)):
                if least(q) > 1:  # a group has a row anyway
                    any_ = passed if not isinstance(p, Varied) else p.pid == i if passed is None else passed & (p.pid == i)
                    counted = None if not isinstance(p, Varied) or p.own else F.lit(True) if passed is None else passed
                    sizes += [(any_, counted, r and F.col(r), least(q)) for r in rids]
            if sizes:
                short.append(too_small(sizes))
                value = value if suppress else sized(value, short[-1], f"{method} as {name} over too small a group")
            out.append(value.alias(name))
            made[name] = replace(m, policy=any_of(after, look) if isinstance(after, Varied) else after)
        ids = [m.policy.pid.alias(shadow(n)) for n, m in made.items() if isinstance(m.policy, Varied)]
        rid, held = f"_rid_{next(NUMBERS)}", {n for n, m in made.items() if not m.policy.released}
        if held:  # what is left to be discharged counts groups from here on
            ids.append((F.xxhash64(*(f"`{k}`" for k in self.keys)) if self.keys else F.lit(0).cast("long")).alias(rid))
        made = {n: replace(m, origin=frozenset([rid]) if n in held else frozenset(), picked=frozenset()) for n, m in made.items()}
        if short and suppress:
            ids.append(reduce(lambda a, b: a | b, short).alias("_small"))
        df = groups.agg(*out, *ids)
        df = df.where("not _small").drop("_small") if short and suppress else df
        return replace(f._taken(df, made, (), frozenset([frozenset(self.keys)])), _repeated=frozenset())


def noisy(method: str, e: Expr | None, c: Column, p: Policy | Varied, passed: Column, epsilon: float) -> tuple[Column, Policy | Varied, float]:
    """A sum or count with noise for what one cell can change: a sum needs clip()'s bounds."""
    if method == "laplace_sum":
        if e is None or e.bounds is None:
            raise ValueError("laplace_sum needs clip()")
        value, sensitivity = F.coalesce(F.sum(F.when(passed, c)), F.lit(0)), max(map(abs, e.bounds))
    else:
        value, sensitivity = F.count_if(passed & c.isNotNull()), 1.0
    return value + laplace_of(epsilon, sensitivity), lift(lambda p: p.downgrade(N(epsilon), method), p), epsilon
