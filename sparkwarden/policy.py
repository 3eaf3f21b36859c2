"""Data-use policies: a chain of labels that must be discharged, head first, before a cell may be released.

Labels, lowest to highest: BOT (any operation will do), T (named transforms), A (aggregations over groups of at least k
rows), N (noise), TOP (nothing will do). Pure Python; no Spark in here.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

LEVEL = {"bot": 0, "T": 1, "A": 2, "N": 3, "top": 4}
#: Names of the same operation.
ALIAS = {"+": "add", "-": "sub", "*": "mul", "/": "div", "%": "mod", "^": "pow", "avg": "mean"}


class PolicyError(Exception):
    """What this library raises by itself; `code` tells the kinds apart."""

    code = "compute"


class NotFound(PolicyError, KeyError):
    """A column or table that isn't there."""

    code = "not found"


class Duplicate(PolicyError, ValueError):
    """Names that should differ, in more than case."""

    code = "duplicate"


class PolicyViolation(PolicyError):
    """An operation or a release that a policy forbids."""

    code = "privacy"

    def __init__(self, what: str, column: str = "", policy: Policy | None = None) -> None:
        super().__init__(f"{what}" + (f" on column {column!r}" if column else "") + (f": {policy}" if policy is not None else ""))
        self.what, self.column, self.policy = what, column, policy


class NotAllowed(PolicyViolation):
    """A statement, relation or plan node that isn't known to be safe, whatever the policies say."""

    code = "invalid operation"


def norm(name: str) -> str:
    return ALIAS.get(name.lower(), name.lower())


def value(x: Any) -> Any:
    """Operation arguments compare by value, whatever their numeric type."""
    return Decimal(str(x)).normalize() if isinstance(x, (int, float, Decimal)) and not isinstance(x, bool) else x


@dataclass(frozen=True)
class Label:
    kind: str
    #: T: (name, argument, tuple of arguments or None); A: (method, least group size); N: (epsilon, delta)
    ops: frozenset = frozenset()

    def join(self, other: Label) -> Label:
        if LEVEL[self.kind] != LEVEL[other.kind]:
            return max(self, other, key=lambda x: LEVEL[x.kind])
        if self.kind == "T":
            return Label("T", self.ops & other.ops)
        if self.kind == "A":
            a, b = dict(self.ops), dict(other.ops)
            return Label("A", frozenset((m, max(a[m], b[m])) for m in a.keys() & b.keys()))
        if self.kind == "N":
            return Label("N", frozenset([min(self.ops | other.ops, key=lambda p: (p[0], p[1] or 0))]))
        return self

    def flows(self, other: Label) -> bool:
        return self.join(other) == other

    def permits(self, op: Label) -> bool:
        """Whether doing `op` discharges this label."""
        if self.kind == "bot":
            return True
        if self.kind != op.kind or self.kind == "top":
            return False
        if self.kind == "A":
            need = dict(self.ops)
            return all(m in need and n >= need[m] for m, n in op.ops)
        if self.kind == "N":  # noise of the same epsilon or a smaller one, which is more noise
            return bool(op.ops) and all(any(e <= x and (d or 0) <= (y or 0) for x, y in self.ops) for e, d in op.ops)
        return bool(op.ops) and op.ops <= self.ops

    def __str__(self) -> str:
        show = {"T": lambda o: o[0] + ("" if o[1] is None else "".join(f":{x}" for x in (o[1] if isinstance(o[1], tuple) else (o[1],)))), "A": lambda o: f"{o[0]}>={o[1]}", "N": lambda o: f"{o[0]},{o[1]}"}
        return self.kind if self.kind in ("bot", "top") else f"{self.kind}{{{', '.join(sorted(map(show[self.kind], self.ops)))}}}"


BOT, TOP = Label("bot"), Label("top")


def T(name: str, *args: Any) -> Label:
    """A transform by its name and its other arguments: one by itself, several as a tuple."""
    given = tuple(map(value, args))
    return Label("T", frozenset([(norm(name), given if len(given) > 1 else given[0] if given else None)]))


def A(*methods: str, k: int = 1) -> Label:
    return Label("A", frozenset((norm(m), k) for m in methods))


def N(epsilon: float, delta: float | None = None) -> Label:
    return Label("N", frozenset([(epsilon, delta)]))


@dataclass(frozen=True)
class Policy:
    labels: tuple[Label, ...] = ()

    def then(self, label: Label) -> Policy:
        """The label behind the others; it must be lower than the last."""
        if self.labels and self.labels[-1].flows(label):
            raise ValueError(f"{label} can't follow {self.labels[-1]}")
        return Policy((*self.labels, label))

    @property
    def valid(self) -> bool:
        return all(LEVEL[a.kind] >= LEVEL[b.kind] for a, b in zip(self.labels, self.labels[1:]))

    @property
    def released(self) -> bool:
        return self.labels in ((), (BOT,))

    def at(self, name: str) -> Policy:
        """As the policy of a column of that name: the same."""
        return self

    def le(self, other: Policy) -> bool:
        if not self.labels:
            return True
        return bool(other.labels) and self.labels[0].flows(other.labels[0]) and Policy(self.labels[1:]).le(Policy(other.labels[1:]))

    def join(self, other: Policy) -> Policy:
        if not self.labels or not other.labels:
            return self if self.labels else other
        a, b = self.labels[0], other.labels[0]
        if a.kind == b.kind:
            return Policy((a.join(b), *Policy(self.labels[1:]).join(Policy(other.labels[1:])).labels))
        high, low = (self, other) if LEVEL[a.kind] > LEVEL[b.kind] else (other, self)
        return Policy((high.labels[0], *Policy(high.labels[1:]).join(low).labels))

    def downgrade(self, op: Label, what: str, column: str = "") -> Policy:
        """After `op`: without the head if that permits it; unchanged below the head's level; else a violation."""
        if not self.labels or self.labels == (BOT,):
            return Policy()
        head = self.labels[0]
        if head.permits(op):
            return Policy(self.labels[1:])
        if LEVEL[head.kind] < LEVEL[op.kind]:
            return self
        raise PolicyViolation(what, column, self)

    def __str__(self) -> str:
        return " => ".join(map(str, (*self.labels,))) or "clean"


CLEAN = Policy()


def parse(text: str) -> Policy:
    """'T{+:1} => A{sum>=5} => bot'; '' and 'clean' are the clean policy. Arguments of a transform stand behind colons, as in T{substring:1:2}."""
    out = Policy()
    for part in filter(None, (x.strip() for x in text.split("=>"))):
        if part == "clean":
            continue
        if part in ("bot", "top"):
            label = BOT if part == "bot" else TOP
        elif m := re.fullmatch(r"([TAN])\{(.*)\}", part):
            items = [x.strip() for x in m[2].split(";" if m[1] == "N" else ",") if x.strip()]
            if m[1] == "T":
                label = Label("T", frozenset((norm(n), _arguments(a) if sep else None) for n, sep, a in (x.partition(":") for x in items)))
            elif m[1] == "A":
                label = Label("A", frozenset((norm(n.strip()), int(k or 1)) for n, _, k in (x.partition(">=") for x in items)))
            else:
                label = Label("N", frozenset((float(e), float(d) if d else None) for e, _, d in (x.partition(",") for x in items)))
        else:
            raise ValueError(f"not a label: {part!r}")
        if out.labels and (out.labels[-1] == BOT or label == TOP):
            raise ValueError(f"{label} can't follow {out.labels[-1]}")  # what comes after bot, or before top, would never count
        out = Policy((*out.labels, label))
    return out


def _arguments(x: str) -> Any:
    found = tuple(map(_literal, x.split(":")))
    return found if len(found) > 1 else found[0]


def _literal(x: str) -> Any:
    try:
        return value(Decimal(x.strip()))
    except ArithmeticError:
        return x.strip()


def to_json(p: Policy) -> str:
    show = lambda a: None if a is None else list(map(str, a)) if isinstance(a, tuple) else str(a)
    return json.dumps([[x.kind, sorted(([o[0], show(o[1])] for o in x.ops), key=str)] for x in p.labels])


def from_json(text: str) -> Policy:
    given = lambda a: None if a is None else tuple(map(_literal, a)) if isinstance(a, list) else _literal(a)
    number = lambda a: None if a is None else float(a)
    read = {"T": lambda o: (o[0], given(o[1])), "A": lambda o: (o[0], int(o[1])), "N": lambda o: (float(o[0]), number(o[1]))}
    return Policy(tuple(Label(kind, frozenset(map(read[kind], ops)) if ops else frozenset()) for kind, ops in json.loads(text)))
