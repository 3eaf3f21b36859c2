"""Policies that vary by row: an integer beside each cell says which policy of a small table the cell has.

An operation is settled once for each policy of the table (or pair of them), on the driver; rows only have their integers
mapped by built-in functions. What an operation forbids becomes TOP, which nothing discharges: release() finds whether
any row has it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import CLEAN, TOP, Policy, PolicyViolation, parse

DENIED = Policy((TOP,))
#: Of tables up to this size all sets of policies that a group can have are laid out; of larger ones all joins of policies, up to this many
#: pairs of a join and a policy; beyond that the sets that groups have are looked up.
EXACT, PAIRS = 6, 20_000


def shadow(name: str) -> str:
    return f"_pid_{name}"


@dataclass(frozen=True)
class Varied:
    pid: Column
    table: tuple[Policy, ...]
    #: Whether a group's size is the number of its rows that have the policy (else of all its rows).
    own: bool = False

    @property
    def released(self) -> bool:
        return all(p.released for p in self.table)

    def held(self) -> list[int]:
        """Ids of policies that forbid a release."""
        return [i for i, p in enumerate(self.table) if not p.released]

    def number(self, values: list[int]) -> Column:
        """The value of each row's policy."""
        return F.element_at(F.array(*map(F.lit, values)), self.pid + 1)

    def text(self) -> Column:
        """Each row's policy as text."""
        return F.element_at(F.array(*(F.lit(str(p)) for p in self.table)), self.pid + 1)

    def at(self, name: str) -> Varied:
        return Varied(F.col(f"`{shadow(name)}`"), self.table, self.own)

    def padded(self) -> Varied:
        """Rows without an id are clean."""
        return Varied(F.coalesce(self.pid, F.lit(len(self.table))), (*self.table, CLEAN), self.own)


@dataclass(frozen=True)
class ByRow:
    """The first rule that holds for a row gives its policy: ((condition over the row's columns, as a Column or SQL, policy), ...)."""

    rules: tuple[tuple[Column | str, str | Policy], ...]
    otherwise: str | Policy = CLEAN

    def varied(self) -> Varied:
        table = [parse(p) if isinstance(p, str) else p for p in (*(p for _, p in self.rules), self.otherwise)]
        pid = F.lit(len(self.rules))
        for i, (condition, _) in reversed(list(enumerate(self.rules))):
            pid = F.when(F.expr(condition) if isinstance(condition, str) else condition, F.lit(i)).otherwise(pid)
        return Varied(pid, tuple(table))


def lift(fn: Callable[..., Policy], *given: Policy | Varied) -> Policy | Varied:
    """`fn` of each combination of policies that rows can have."""
    varied = [p for p in given if isinstance(p, Varied)]
    if not varied:
        return fn(*given)

    def settled(*ps: Policy) -> Policy:
        try:
            return fn(*ps)
        except PolicyViolation:
            return DENIED

    results = [settled(*ps) for ps in itertools.product(*(p.table if isinstance(p, Varied) else (p,) for p in given))]
    table = tuple(dict.fromkeys(results))
    if len(table) == 1 and table[0] != DENIED:
        return table[0]
    pid = reduce(lambda at, p: at * len(p.table) + p.pid, varied, F.lit(0))
    return Varied(Varied(pid, tuple(results)).number([table.index(r) for r in results]), table, any(p.own for p in varied))


def worst(p: Policy | Varied) -> Policy:
    return reduce(Policy.join, p.table) if isinstance(p, Varied) else p


def any_of(p: Varied, look: Callable[[Column], list[str]]) -> Varied:
    """As an aggregate: the join of the policies that rows of a group have. `look` gives the different values that an aggregate
    has over the groups; it is asked beyond EXACT and PAIRS only, as a job whose result has a row for each set found."""
    if len(p.table) > EXACT and (joins := joined(p.table)):
        n, table = len(p.table), tuple(joins)
        step = F.array(*(F.lit(joins[j.join(q)]) for j in table for q in p.table))
        at = F.aggregate(F.collect_set(p.pid), F.lit(0), lambda done, x: F.element_at(step, done * n + x + 1))
        return Varied(at, table)
    if len(p.table) > EXACT:
        key = F.array_join(F.array_sort(F.collect_set(p.pid)).cast("array<string>"), ",")
        found = sorted(look(key))
        joins = [reduce(Policy.join, (p.table[int(i)] for i in k.split(",") if i), CLEAN) for k in found]
        table = tuple(dict.fromkeys(joins)) or (CLEAN,)
        at = F.element_at(F.create_map(*(F.lit(x) for k, j in zip(found, joins) for x in (k, table.index(j)))), key) if found else F.lit(0)
        return Varied(at, table)
    return of_bits(p, bits_of(p))


def bits_of(p: Varied) -> Column:
    """As an aggregate: a bit for each policy of the table that a row has."""
    return F.bit_or(p.number([1 << i for i in range(len(p.table))]))


def of_bits(p: Varied, bits: Column) -> Varied:
    """The join of the policies whose bits are set."""
    subsets = [reduce(Policy.join, (q for i, q in enumerate(p.table) if mask >> i & 1), CLEAN) for mask in range(1 << len(p.table))]
    table = tuple(dict.fromkeys(subsets))
    return Varied(Varied(F.coalesce(bits, F.lit(0)), tuple(subsets)).number([table.index(s) for s in subsets]), table)


def joined(table: tuple[Policy, ...]) -> dict[Policy, int]:
    """All joins of the policies, numbered from the clean one on; empty if there are too many. Most policies have few: of group sizes the
    largest is the join."""
    found, todo = {CLEAN: 0}, [CLEAN]
    while todo:
        one = todo.pop()
        for p in table:
            both = one.join(p)
            if both not in found:
                if (len(found) + 1) * len(table) > PAIRS:
                    return {}
                found[both] = len(found)
                todo.append(both)
    return found


def chosen(test: Column, yes: Policy | Varied, no: Policy | Varied) -> Policy | Varied:
    """The policy of the arm that each row takes."""
    if not isinstance(yes, Varied) and yes == no:
        return yes
    one, two = (p if isinstance(p, Varied) else Varied(F.lit(0), (p,)) for p in (yes, no))
    table = tuple(dict.fromkeys((*one.table, *two.table)))
    one, two = (Varied(x.number([table.index(q) for q in x.table]), table) for x in (one, two))
    return Varied(F.when(test, one.pid).otherwise(two.pid), table, True)


def merged(a: Policy | Varied, b: Policy | Varied) -> tuple[Policy | Varied, Policy | Varied]:
    """Both over one table, for the two sides of a union; two policies that are the same for all rows are joined."""
    if not isinstance(a, Varied) and not isinstance(b, Varied):
        return a.join(b), a.join(b)
    sides = [p if isinstance(p, Varied) else Varied(F.lit(0), (p,)) for p in (a, b)]
    table = tuple(dict.fromkeys((*sides[0].table, *sides[1].table)))
    one, two = (Varied(s.number([table.index(p) for p in s.table]), table) for s in sides)
    return one, two
