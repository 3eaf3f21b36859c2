"""Repair of damaged conversations: the cheapest edits that give each a proper order of turns.

Edits run over the rows of a conversation in order, through four states: nothing said yet, system said, user said, assistant said. A step is a macro of
some inserted turns and one edit of the row (delete, keep, rerole), written as a code such as D, IK or IIR. No code is the beginning
of another, so sequences of equally many codes compare as their letters do, and the audits of a layer (one for each state
after so many rows) need no strings: each has a rank, found from the rank of its parent and its code's place in order. A layer is four
costs and four ranks, and four parent pointers of a byte each, from which the audit is written in the end.

A conversation of any length is cut into segments of at most SEGMENT rows, with a layer for each state a segment may begin in.
A fold over the segments' ends alone (costs and ranks; of two ways through different states the rank at the cut decides) settles the
states at the cuts, and each segment's pointers are walked back by themselves. Rows are ordered by a range partitioning, so a hot conversation is spread as well. Only
the digest of the repaired text takes a conversation's rows one after another: as a stream, in one task, that holds a segment's pointers and the audit.

Rows are ordered by turn (nulls first), then role and text; repeated rows are duplicates of their first. Null roles and texts are one space,
null conversations are one, and each null turn counts as a row without turn. A role is kept by its first letter (s, u or a, as it is written); an empty
role is never kept. Texts of any length are whole. A conversation without rows has zeros, an empty audit and the hash of nothing; an
empty table gives no rows. Extra columns of any name are left out.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a segment: a power of two.
SEGMENT = 4096
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: First letters of roles, as numbers; any other is 3. Faults: 0 for none.
WHO = {"s": 0, "u": 1, "a": 2}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
FAR = 1 << 40
# Costs of edits.
RETOLD, DELETED, INSERTED, CUT_OFF = 1, 2, 5, 5
CODES = sorted("I" * n + e for n in range(3) for e in "DKR")
#: Turns that must still be inserted at the end.
TAIL = {NOTHING: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}


def told(state: int) -> int:
    """After a user's or an assistant's turn, whichever comes next."""
    return ASSISTANT if state == USER else USER


def kept(state: int, who: int) -> int | None:
    if who == 0 and state == NOTHING:
        return SYSTEM
    return told(state) if who == (2 if state == USER else 1) else None


@functools.cache
def macros(who: int, fault: int) -> list[list[tuple[int, int, int]]]:
    """For each state the ways into it over a row of the kind: (state before, cost, place of the code in order)."""
    into: list[list[tuple[int, int, int]]] = [[] for _ in range(4)]
    for before in range(4):
        for place, code in enumerate(CODES):
            state, cost = before, INSERTED * (len(code) - 1)
            for _ in code[:-1]:
                state = told(state)
            if code[-1] == "D":
                into[state].append((before, cost + DELETED, place))
            elif fault not in (BLANK, DUPLICATE):
                after = told(state) if code[-1] == "R" else kept(state, who)
                if after is not None:
                    more = (RETOLD if code[-1] == "R" else 0) + (CUT_OFF if fault == TRUNCATED else 0)
                    into[after].append((before, cost + more, place))
    return into


def ranked(ways: list[tuple | None]) -> tuple[int, ...]:
    """The place of each in order; what isn't there comes last."""
    order = sorted((w, i) for i, w in enumerate(ways) if w is not None)
    place = {i: k for k, (_, i) in enumerate(order)}
    return tuple(place.get(i, len(ways)) for i in range(len(ways)))


@functools.lru_cache(1 << 16)
def layer(costs: tuple[int, ...], ranks: tuple[int, ...], who: int, fault: int) -> tuple[int, tuple[int, ...], tuple[int, ...], bytes]:
    """After a row: what all costs have grown by at least, costs beyond that, ranks, and a pointer for each state: state before + 4 * code."""
    best = [min(((costs[b] + c, ranks[b], p, b) for b, c, p in ways if costs[b] < FAR), default=None) for ways in macros(who, fault)]
    least = min(w[0] for w in best if w)
    back = bytes(w[3] + 4 * w[2] if w else 255 for w in best)
    return least, tuple(w[0] - least if w else FAR for w in best), ranked([w and (w[1], w[2]) for w in best]), back


def through(rows: list[tuple[int, int]], start: int) -> tuple[list[int], list[int], bytes]:
    """Costs and ranks of each state after the rows (who, fault), from one state, and the pointers of all layers."""
    costs, ranks, total, back = tuple(0 if s == start else FAR for s in range(4)), (0,) * 4, 0, []
    for who, fault in rows:
        least, costs, ranks, b = layer(costs, ranks, who, fault)
        total += least
        back.append(b)
    return [c + total if c < FAR else FAR for c in costs], list(ranks), b"".join(back)


def walked(back: bytes, end: int) -> list[str]:
    """The codes of the rows on the way to the state `end`."""
    out = []
    for at in range(len(back) - 4, -1, -4):
        b = back[at + end]
        out.append(CODES[b >> 2])
        end = b & 3
    return out[::-1]


def legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def pieces(t: pa.Table) -> pa.Table:
    """Of a segment's rows (conv_id, seg, at, turn, who, fault): a row for each conversation in it. All but the first begin in it."""
    t = t.sort_by("at")
    ids = t["conv_id"].combine_chunks()
    code = ids.dictionary_encode(null_encoding="encode").indices.to_pylist()
    at, turn, who, fault = (t[c].to_pylist() for c in ("at", "turn", "who", "fault"))
    cuts = [0, *(i for i in range(1, len(code)) if code[i] != code[i - 1]), len(code)]
    out: dict[str, list] = {c: [] for c in ("at", "n", "faults", "illegal", "ends", "turns", "costs", "ranks", "back")}
    for a, b in zip(cuts, cuts[1:]):
        rows = list(zip(who[a:b], fault[a:b]))
        found = [through(rows, s) for s in (range(4) if a == 0 else (NOTHING,))]
        given = [x for x in turn[a:b] if x is not None]
        out["at"].append(at[a])
        out["n"].append(b - a)
        out["faults"].append([sum(f == k for _, f in rows) for k in (BLANK, DUPLICATE, TRUNCATED)])
        out["illegal"].append(sum(not legal(x, y) for (x, _), (y, _) in zip(rows, rows[1:])))
        out["ends"].append([rows[0][0], rows[-1][0]])
        out["turns"].append([given[0], given[-1], len(set(given))] if given else [])
        out["costs"].append([c for f in found for c in f[0]])
        out["ranks"].append([r for f in found for r in f[1]])
        out["back"].append([f[2] for f in found])
    kinds = {"ends": pa.list_(pa.int64()), "turns": pa.list_(pa.int64()), "faults": pa.list_(pa.int64()), "costs": pa.list_(pa.int64())}
    kinds |= {"ranks": pa.list_(pa.int64()), "back": pa.list_(pa.binary())}
    return pa.table({"conv_id": ids.take(pa.array(cuts[:-1])), **{c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()}})


PIECES = "at long, n long, faults array<long>, illegal long, ends array<long>, turns array<long>, costs array<long>, ranks array<long>, back array<binary>"


class Fold:
    """A conversation's segments, one after another; only their ends."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.chosen: list[list[int]] = []
        self.costs, self.ranks = [0, FAR, FAR, FAR], (0,) * 4
        self.counts, self.distinct = [0, 0, 0, 0], 0
        self.who: int | None = None
        self.first: int | None = None
        self.last: int | None = None

    def add(self, at: int, faults: list[int], illegal: int, ends: list[int], turns: list[int], costs: list[int], ranks: list[int]) -> None:
        self.counts = [a + b for a, b in zip(self.counts, [*faults, illegal + (self.who is not None and not legal(self.who, ends[0]))])]
        self.who = ends[1]
        if turns:
            self.distinct += turns[2] - (turns[0] == self.last)
            self.first, self.last = turns[0] if self.first is None else self.first, turns[1]
        ways = []
        for e in range(4):
            way = [(self.costs[m] + costs[4 * m + e], self.ranks[m], ranks[4 * m + e], m) for m in range(len(costs) // 4)]
            ways.append(min((w for w in way if w[0] < FAR), default=None))
        self.costs, self.ranks = [w[0] if w else FAR for w in ways], ranked([w and w[1:3] for w in ways])
        self.at.append(at)
        self.chosen.append([w[3] if w else -1 for w in ways])

    def plans(self) -> list[tuple]:
        """For each segment (at, state before, state after, turns inserted behind it, the conversation's numbers with the first)."""
        cost, _, end = min((self.costs[s] + INSERTED * n, self.ranks[s], s) for s, n in TAIL.items())
        gaps = 0 if self.first is None or self.last is None else self.last - self.first + 1 - self.distinct
        out = []
        for i in range(len(self.at) - 1, -1, -1):
            before = self.chosen[i][end]
            out.append((self.at[i], before, end, TAIL[end] if not out else 0, [gaps, *self.counts, cost] if i == 0 else None))
            end = before
        return out


def same(a: object, b: object) -> bool:
    return a == b or a != a and b != b  # NaN is one conversation


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces by conversation and place: the plan of each."""
    fold, name = None, None

    def out(plans: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*plans), kinds)], ["at", "before", "after", "tail", "numbers"])

    for batch in batches:
        done: list[tuple] = []
        for conv, *piece in zip(*(c.to_pylist() for c in batch.columns)):
            if fold is None or not same(conv, name):
                done += fold.plans() if fold else []
                fold, name = Fold(), conv
            fold.add(*piece)
        if done:
            yield out(done)
    if fold:
        yield out(fold.plans())


class Retelling:
    """A conversation's repaired rows as a stream into a hash."""

    def __init__(self) -> None:
        self.sha, self.audit, self.state, self.lines = hashlib.sha256(), [], NOTHING, 0
        self.codes: Iterator[str] = iter(())
        self.tail, self.numbers = 0, [0] * 6

    def tell(self, role: bytes, text: bytes) -> None:
        self.sha.update((b"\n" if self.lines else b"") + role + b":")
        self.sha.update(text)
        self.lines += 1

    def insert(self, n: int) -> None:
        for _ in range(n):
            self.state = told(self.state)
            self.tell(b"assistant" if self.state == ASSISTANT else b"user", b"")

    def plan(self, back: bytes, end: int, tail: int, numbers: list[int] | None) -> None:
        codes = walked(back, end)
        self.audit.append("".join(codes))
        self.codes, self.tail, self.numbers = iter(codes), tail, numbers or self.numbers

    def row(self, role: bytes, text: bytes, who: int) -> None:
        code = next(self.codes)
        self.insert(len(code) - 1)
        if code[-1] == "R":
            self.state = told(self.state)
            self.tell(b"assistant" if self.state == ASSISTANT else b"user", text)
        elif code[-1] == "K":
            self.state = kept(self.state, who)
            self.tell(role, text)

    def end(self) -> tuple:
        self.insert(self.tail)
        return (*self.numbers, "".join(self.audit) + "I" * self.tail, self.sha.hexdigest())


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def retold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a conversation's name, plans and rows in order (what: 0 to 2): its numbers, audit and digest."""
    kinds = [*[pa.int64()] * 6, pa.string(), pa.string()]
    at, name = None, None

    def out(of: list, rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([pa.array(of, kind), *columns], ["conv_id", *NUMBERS, "audit", "repaired_sha256"])

    kind = pa.null()
    for batch in batches:
        kind, of, done = batch.column(0).type, [], []
        ids, what, who = (batch.column(i).to_pylist() for i in (0, 1, 2))
        for i, conv in enumerate(ids):
            if at is None or not same(conv, name):
                if at is not None:
                    of.append(name)
                    done.append(at.end())
                at, name = Retelling(), conv
            value = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
            if what[i] == 1:
                at.plan(value(5), value(6), value(7), value(8))
            elif what[i] == 2:
                at.row(value(3), value(4), who[i])
        if done:
            yield out(of, done, kind)
    if at is not None:
        yield out([name], [at.end()], kind)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the row's checksum picks."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    pick = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    text = F.when(pick == 1, "").when(pick == 2, F.regexp_replace(name[3], "[.!?]", "")).otherwise(name[3])
    role = F.when(pick == 4, "user").otherwise(name[2])
    out = rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), role.alias("role"), text.alias("text"), pick.alias("pick")).where("pick <> 0")
    return out.withColumn("copy", F.explode(F.when(F.col("pick") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("pick", "copy")


def who_of(role: Column) -> Column:
    first = F.left(role, F.lit(1))
    return F.when(first == "s", WHO["s"]).when(first == "u", WHO["u"]).when(first == "a", WHO["a"]).otherwise(3)


def ordered(spark: SparkSession, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with `at`, their place in order of conversation, turn, role and text over the whole table (with gaps)."""
    rows = rows.withColumn("uid", F.monotonically_increasing_id())  # equal rows may be cut apart
    keys = ["conv_id", "turn", "role", "text", "uid"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("uid")
    return scratch.stage(rows.withColumn("at", F.monotonically_increasing_id()), "ordered")


def repair(conversations: DataFrame, damage: bool = True, segment: int = SEGMENT) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conv_id of the table."""
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession, "repair")
    given = conversations.select("conv_id", "turn", "role", "text")
    rows = damaged(given) if damage else given.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
    rows = ordered(spark, rows, scratch)
    name = given.schema["conv_id"].dataType.simpleString()
    text = (F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), F.col("text")).alias("u"))
    firsts = rows.groupBy("conv_id", "role", *text).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    cut_off = ~F.right(end, F.lit(1)).isin(".", "!", "?")
    slim = rows.select("conv_id", "at", "turn", who_of(F.col("role")).alias("who"), (end == "").alias("blank"), cut_off.alias("cut_off"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut_off"), TRUNCATED).otherwise(0)
    slim = slim.join(firsts, "at", "left").select("conv_id", "at", "turn", "who", fault.alias("fault"), F.floor(F.col("at") / segment).alias("seg"))
    found = scratch.stage(slim.groupBy("seg").applyInArrow(pieces, f"conv_id {name}, {PIECES}"), "pieces")
    ends = found.select("conv_id", "at", "faults", "illegal", "ends", "turns", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    plans = map_batches(ends, folded, "at long, before int, after int, tail int, numbers array<long>")
    plans = scratch.stage(plans, "plans")
    plans = found.select("conv_id", "at", "back").join(plans, "at")
    none = {"who": "int", "role": "binary", "text": "binary", "back": "binary", "after": "int", "tail": "int", "numbers": "array<long>"}
    columns = lambda what, **own: [F.lit(what).alias("what"), *(own.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items())]
    names = given.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long").alias("at"), *columns(0))
    pointers = F.col("back")[F.col("before")]
    told_by = plans.select("conv_id", "at", *columns(1, back=pointers, after=F.col("after"), tail=F.col("tail"), numbers=F.col("numbers")))
    texts = rows.select("conv_id", "at", *columns(2, who=who_of(F.col("role")), role=F.col("role"), text=F.col("text")))
    both = names.unionByName(told_by).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "at", "what")
    both = both.select("conv_id", "what", "who", "role", "text", "back", "after", "tail", "numbers")
    return map_batches(both, retold, f"conv_id {name}, {', '.join(f'{c} long' for c in NUMBERS)}, audit string, repaired_sha256 string")
