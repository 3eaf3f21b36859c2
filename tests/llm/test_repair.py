"""Conversation repair against a search over whole audit strings."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from sparkwarden.llm import repair

from .fixtures import SF

WORD = re.compile(r"[^\x20\x09-\x0D]")
PROPER = re.compile("(s?(ua)+)?")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        show = lambda x: " " if x is None else str(x)
        pick = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = "user" if pick == 4 else show(role), {1: "", 2: re.sub("[.!?]", "", show(text))}.get(pick, show(text))
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(pick, 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """Dijkstra over (row, initials so far in short), popped by cost and then by audit."""
    def short(said):  # what can still follow depends on no more than this
        return said[-1:] if said else ""

    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, said, told = heapq.heappop(heap)
        if (at, short(said)) in done:
            continue
        if at == len(rows) and PROPER.fullmatch(said):
            return cost, audit, told
        done.add((at, short(said)))
        can = lambda x: any(PROPER.fullmatch(said + x + rest) for rest in ("", "a", "ua", "uaua"))  # noqa: B023, E731
        for role in ("user", "assistant"):
            if can(role[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", at, said + role[0], (*told, f"{role}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, said, told))
            if bad[at] not in ("blank", "duplicate"):
                more = 5 if bad[at] == "truncated" else 0
                if role and can(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, said + role[0], (*told, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    if can(to[0]):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, said + to[0], (*told, f"{to}:{text}")))
    raise AssertionError


def brute(rows):
    out = {}
    for conv, mine in damage(rows).items():
        bad = faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, told = cheapest(mine, bad)
        sha = hashlib.sha256("\n".join(told).encode()).hexdigest()
        out[conv] = (gaps, *(bad.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def found(df, **options):
    rows = [tuple(r) for r in repair.repair(df, **options).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def made(n, seed, roles=("user", "assistant", "system", "tool", "", "summary", None)):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, 9)):
            turn = rng.choice([turn, turn, turn + 3, None])
            rows.append((conv if conv else None, turn, rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(["Yes.", "No", "Why?", " ", "", None, "Go on!\n", "é "])))
    return rows


@pytest.mark.parametrize("segment", [1, 2, 4096])
def test_made(spark, segment):
    rows = made(150, 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as at", "2 as who", "'x' as `a.b`", "3 as cost")
    assert found(df.repartition(5), segment=segment) == brute(rows)


def test_real_and_strings(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows)
    assert found(df) == want
    named = df.selectExpr("concat('c', conv_id) AS conv_id", "turn", "role", "text")
    assert found(named) == brute([(f"c{r[0]}", *r[1:]) for r in rows])
    assert repair.repair(df.limit(0)).collect() == []


def test_hot_and_long(spark):
    """One conversation of many segments, of which many rows are equal, and a text of some megabytes."""
    rng = random.Random(4)
    rows = [(7, rng.randrange(900), rng.choice(["user", "assistant", "system"]), rng.choice([f"t{i}.", "Same.", "cut"])) for i in range(1500)]
    rows += [(8, 1, "user", "x" * (3 << 20) + "?"), (8, 2, "assistant", "y.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(df, segment=64) == brute(rows)


def test_codes():
    for a in repair.CODES:
        assert not any(a != b and b.startswith(a) for b in repair.CODES)
    assert repair.CODES == sorted(repair.CODES)
