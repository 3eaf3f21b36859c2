"""Mixing sources to target weights with Sainte-Lague quotas.

The words of a source form one line: its documents in seeded order, shard by shard. The line is cut
into blocks of equal size. Sources get whole blocks by highest quotients (target / (2 s + 1), the divisor
method of Sainte-Lague); each source's quota is split over its shards the same way. In a shard of n blocks with
quota q every block is taken q // n times, and q % n of them, picked by a seeded permutation, once more.
A document takes the words it has in those blocks.

Rows with null source form a source of their own; texts without words take nothing; equal ids and
repeated rows are ordered by their text's hash; rows of a null id by the text's hash alone. A text of any length is one run of the line, of which only
the number of words is kept. Extra columns of any name are left out, and stay where rows are picked. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, free_prefix, names, plain, small

SEED = 97
#: Words in a block: what a source's share can be off by.
BLOCK = 64
#: Shards of a source's line: rows of a source that one task sorts are a 1/SHARDS of it.
SHARDS = 256


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients vote / (2 s + 1); ties to the first. Found by the divisor, then trimmed by quotient,
    so the work doesn't follow the number of seats."""
    n, total = len(votes), float(sum(votes))
    if seats <= 0 or total <= 0:
        return [0] * n
    got = [max(0, math.floor(v * seats / total - 0.5)) for v in votes]  # no more than the method gives, but for rounding
    while sum(got) > seats:
        i = max(range(n), key=lambda k: (got[k] > 0, -(votes[k] / (2 * got[k] - 1)) if got[k] else 0, k))
        got[i] -= 1
    import heapq

    heap = [(-(v / (2 * g + 1)), k) for k, (v, g) in enumerate(zip(votes, got)) if v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-(votes[k] / (2 * got[k] + 1)), k))
    return got


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words for each source: `share` of all words by weight (sources by code point, null last, weigh in turn), none
    above `most` times its size; what is above is shared again by weight."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, active, out = share * sum(sizes.values()), list(order), {}
    while active:
        unit = left / sum(weight[s] for s in active)
        over = [s for s in active if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in active}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            active.remove(s)
    return out


def shard_quotas(rows: pd.DataFrame, block: int, quota: dict[str | None, int], seed: int) -> pd.DataFrame:
    """Of one source, whose shards are the rows: where each shard starts in the source's line, its first block, number of
    blocks, quota and permutation."""
    rows = rows.sort_values("shard").reset_index(drop=True)
    start = rows["words"].cumsum() - rows["words"]
    first = -(-start // block)  # a block belongs to the shard in which it starts
    n = (-(-(start + rows["words"]) // block) - first).astype(int)
    source = rows["source"].iloc[0]
    source = None if pd.isna(source) else source
    want = min(quota.get(source, 0), 2 * int(n.sum()))
    got = sainte_lague(n.tolist(), want)
    step = []
    for k, m in zip(rows["shard"], n):
        a = (seed * 7919 + int(k) * 104729) % m if m > 1 else 0
        while m > 1 and math.gcd(a, m) != 1:
            a += 1
        step.append(a)
    return pd.DataFrame({"source": rows["source"], "shard": rows["shard"], "line_start": start, "first": first, "n": n, "quota": got, "step": step})


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, text_hash. The sources' names, sizes and weights are on the driver, as a
    mix is always given by source; nothing else leaves the executors."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = plain(docs, doc_id=kind, source="string", text="string").select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("_h"), F.xxhash64("text").alias("_t"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_h", "_t"), F.lit(shards)).cast("int"))
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = scratch.stage(rows, "sizes")
    per_shard = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    size = {r["source"]: int(r["words"]) for r in per_shard.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    target = targets(size, weights, share, most)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    seats = round(sum(target.values()) / block)
    quota = dict(zip(order, sainte_lague([target[s] for s in order], seats)))
    plan = per_shard.groupBy("source").applyInPandas(lambda x: shard_quotas(x, block, quota, seed), "source string, shard int, line_start long, first long, n long, quota long, step long")
    info = spark.createDataFrame([(s, size[s], float(target[s])) for s in order], "source string, source_size long, target double")
    # the shards of each source: SHARDS rows for each, whatever their sizes
    plan = plan.join(F.broadcast(info), plan["source"].eqNullSafe(info["source"])).select(plan["source"].alias("p_source"), plan["shard"].alias("p_shard"), "line_start", "first", "n", "quota", "step", "source_size", "target")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source", "shard").orderBy("_h", "doc_id", "_t", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = rows.withColumn("before", before)
    both = laid.join(plan, laid["source"].eqNullSafe(plan["p_source"]) & (laid["shard"] == plan["p_shard"]))
    both = both.withColumns({"a": F.col("line_start") + F.col("before"), "z": F.col("line_start") + F.col("before") + F.col("size")})
    # The blocks a document touches; the first may have begun in an earlier shard and is then that shard's.
    taken = f"""CASE WHEN size = 0 THEN 0L ELSE aggregate(sequence(a DIV {block}, (z - 1) DIV {block}), 0L, (acc, b) -> acc
        + (least(z, (b + 1) * {block}) - greatest(a, b * {block}))
        * CASE WHEN b < first THEN head ELSE quota DIV nullif(n, 0) + CAST(pmod(step * (b - first) + shard, nullif(n, 0)) < quota % nullif(n, 0) AS BIGINT) END) END"""
    # Times that the block reaching into this shard from before is taken: its own shard's rule.
    prior = plan.select("p_source", F.col("p_shard").alias("_s"), (F.col("first") + F.col("n")).alias("_end"), "n", "quota", "step", "first")
    heads = prior.withColumn("_times", F.when(F.col("n") > 0, F.expr("quota DIV nullif(n, 0) + CAST(pmod(step * (n - 1) + _s, nullif(n, 0)) < quota % nullif(n, 0) AS BIGINT)")))
    w = Window.partitionBy("p_source").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("head", F.coalesce(F.last("_times", ignorenulls=True).over(w), F.lit(0))).select(F.col("p_source").alias("h_source"), F.col("_s").alias("h_shard"), "head")
    both = both.join(heads, both["p_source"].eqNullSafe(heads["h_source"]) & (both["p_shard"] == heads["h_shard"]))
    return both.select("doc_id", laid["source"].alias("source"), "size", "source_size", "target", F.expr(taken).cast("long").alias("taken"), F.col("_t").alias("text_hash"))


def select(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: a document comes as often as its taken words make it whole, a rest by seeded chance; all columns."""
    scratch = Scratch(docs.sparkSession, "mixed")
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(SEED + 1)), 11) / float(1 << 53)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + u)).otherwise(0).cast("int")
    p = free_prefix(docs, "_m_")
    keys = mix(docs, **options).withColumn("_copies", copies).groupBy(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}h")).agg(F.max("_copies").alias(f"{p}copies"))
    keys = small(scratch.stage(keys.where(f"`{p}copies` > 0"), "copies"))
    rows = docs.join(keys, docs["doc_id"].eqNullSafe(keys[f"{p}id"]) & F.xxhash64(docs["text"]).eqNullSafe(keys[f"{p}h"]))
    return rows.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), f"{p}copies"))).select(*(docs[c] for c in names(docs)))
