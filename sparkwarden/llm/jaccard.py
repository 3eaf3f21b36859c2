"""Exact Jaccard join of word shingles over a token-group matrix.

1. Each text becomes its set of distinct 64-bit shingle hashes; equal sets become one node (a 128-bit digest of the set), so
   copies never meet each other.
2. Sieve: the 64 lowest hashes of each node are counted over all nodes. Two sets with Jaccard similarity of 0.75 or more
   share 75 % of the 64 lowest hashes of their union in expectation; a node of which fewer than 16 occur elsewhere has
   no partner (probability of an error for a pair: below 1e-16, like that of equal hashes of different shingles). Nodes of
   up to 64 shingles are seen whole and sieved exactly: they share 75 % of their shingles, and a partner of m > 64, which
   shows 64 of its own, hides m - 64 of the 0.75 m shared at most; m being up to 4 n / 3, 64 - n / 3 are left. With
   sieve=False all nodes go on, and nothing rests on a probability but the hashes.
3. Whole sets of the nodes left: shingles found in one node only can't be shared. In the order (number of nodes, hash) two
   linked sets share one of their first floor(n / 4) + 1 shingles, their front.
4. Groups of similar nodes: a front shingle's leader is the least node that has it; a node goes to the leader with which it
   shares most of its front, and a leader's nodes are dealt by their least shingle hash into groups of about GROUP nodes
   and TOKENS shingles. In a group, its leader among them, all pairs are counted, by blocks of columns. What is linked
   this way has one label.
5. Token-group matrix: the front shingles of each group, with the range of its sets' sizes and labels. A node is a query to
   the groups that have one of its front shingles and a label other than its own; nothing is sent within a label, so families
   of near copies cost no pairs, and of a small and a large label the small one asks. A group's task has the union of the group's shingles, bounds each query's overlap by it, and
   opens only the queries that can reach 0.75. The queries of a group are salted into tasks of QUERIES.
6. Labels are components of links, found by passing on least labels, and carried back to all rows.

Sizes: no step holds a whole hot shingle, leader or group of copies in one task; all joins of unbounded sides are sort-merge
joins over staged tables, whose hot keys Spark splits.

Null texts and texts without words have no shingles and component_id = doc_id. Texts with fewer than `words` words have one
shingle, the whole sequence. Repeated rows share a component. Null ids count as none: a component's id is the least one it has.
A very long text is one set, held by one task at a time (8 bytes a shingle). Extra columns of any name are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, forget_unused, free_prefix, map_slices, plain, small, windows, word_hashes, word_lists

WORDS, SHARE = 5, 75
SKETCH, SHARED = 64, 16
#: Nodes and shingles of a group, and queries that a task holds against it.
GROUP, TOKENS, QUERIES = 256, 1 << 18, 256
#: Nodes of a label that has groups of its own.
LARGE = 12
COLUMNS = 4096


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    h, counts = word_hashes(word_lists(texts, lower=True))
    w = windows(h, words)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(w[at : at + n - words + 1]))
        elif n:
            out.append(windows(h[at : at + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat.view(np.int64)))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label: the least node reachable over edges (node, hub), where nodes of one hub are connected.

    Each hub is first replaced by its least node: families share most of their hubs, so few distinct edges are left to pass over.
    """
    edges = scratch.stage(edges, f"{name}-hubs")
    stars = edges.join(edges.groupBy("hub").agg(F.min("node").alias("least")), "hub").select("node", F.col("least").alias("hub"))
    stars = scratch.stage(stars.distinct(), f"{name}-edges")
    scratch.drop(edges)
    edges = stars
    labels = scratch.stage(edges.select("node", F.col("node").alias("label")).distinct(), f"{name}-labels")
    while True:
        hubs = scratch.stage(edges.join(labels, "node").groupBy("hub").agg(F.min("label").alias("least")), f"{name}-hubs")
        near = scratch.stage(edges.join(hubs, "hub").groupBy("node").agg(F.min("least").alias("near")), f"{name}-near")
        up = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))  # the label's own label
        new = scratch.stage(near.join(up, "near").select("node", F.least("near", "far").alias("label")), f"{name}-labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        scratch.drop(labels, hubs, near)
        labels = new
        if not moved:
            scratch.drop(edges)
            return labels


def link_groups(nodes: list[bytes], sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, share: int = SHARE) -> list[tuple[bytes, bytes]]:
    """Links among the nodes of two groups (left: the first group; all of one group if left is all), as (node, hub)."""
    n = len(nodes)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens, col = np.unique(np.concatenate(sets), return_inverse=True)
    same = bool(left.all())
    sides = (left, left) if same else (left, ~left)
    # Token-group matrix: a row for each group, 1 where one of its sets has the token. In one group a token counts from two sets on.
    uses = [np.bincount(col, side[owner], len(tokens)) for side in sides]
    opened = np.zeros(n, bool)
    for side, other in ((sides[0], uses[1]), (sides[1], uses[0])):
        bound = np.bincount(owner, (other >= (2 if same else 1))[col], n)
        opened |= side & (100 * bound >= share * sizes)
    if opened.sum() < 2:
        return []
    keep = opened[owner]
    owner, col = owner[keep], col[keep]
    both = np.bincount(col, minlength=len(tokens))
    keep = both[col] > 1
    owner, col = owner[keep], col[keep]
    _, col = np.unique(col, return_inverse=True)
    rows = np.flatnonzero(opened)
    at = np.full(n, -1)
    at[rows] = np.arange(len(rows))
    order = np.argsort(col, kind="stable")
    owner, col = at[owner[order]], col[order]
    inter = np.zeros((len(rows), len(rows)), np.float64)
    for a in range(0, int(col.max(initial=-1)) + 1, COLUMNS):
        lo, hi = np.searchsorted(col, [a, a + COLUMNS])
        m = np.zeros((len(rows), COLUMNS), np.float32)
        m[owner[lo:hi], col[lo:hi] - a] = 1
        inter += m @ m.T
    size = sizes[rows].astype(float)
    linked = 100 * inter >= share * (size[:, None] + size[None, :] - inter)
    if not same:
        linked &= left[rows][:, None] != left[rows][None, :]
    parent = list(range(len(rows)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = top(int(i)), top(int(j))
        parent[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(rows)):
        if (t := top(i)) != i:
            out[i] = t
    return [(nodes[rows[i]], nodes[rows[t]]) for i, t in {**out, **{t: t for t in out.values()}}.items()]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, h (hash of the text), n, node, low (the lowest hashes) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        sizes, nodes = pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), sizes, nodes, lists([s[:SKETCH] for s in sets])], names=["doc_id", "h", "n", "node", "low"])

    return map_slices(docs, sketch, f"doc_id {kind}, h long, n long, node binary, low array<long>")


def whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, n and all shingle hashes of each text that has any."""

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        return pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists(sets)], names=["node", "n", "tokens"])

    return map_slices(texts, whole, "node binary, n long, tokens array<long>").where("n > 0")


def sieved(reps: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """The keys of the nodes that can have a partner. Nodes whose 64-bit keys are equal can only keep each other in."""
    tokens = reps.select("key", "n", F.explode("low").alias("t"))
    often = scratch.stage(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("t"), "often")
    shown = F.ceil(F.lit(SKETCH) - F.col("n") * (100 - share) / share)  # at least, by the largest partner
    need = F.when(F.col("n") <= SKETCH, F.least(F.ceil(F.col("n") * share / 100), shown)).otherwise(SHARED)
    hits = tokens.join(often, "t", "left_semi").groupBy("key", "n").agg(F.count(F.lit(1)).alias("hits"))
    return scratch.stage(hits.where(F.col("hits") >= need).select("key").distinct(), "left")


def fronts(docs: DataFrame, rows: DataFrame, words: int, share: int, sieve: bool, scratch: Scratch) -> DataFrame:
    """Staged: node, key (64 bits of it), n, tokens (shingles that other nodes have too) and front of the nodes that can have a partner."""
    first = F.struct("doc_id", "h")
    sets = rows.where("n > 0").groupBy("node").agg(F.min(first).alias("at"), F.first("n").alias("n"), F.first("low").alias("low"))
    reps = scratch.stage(sets.select("node", F.xxhash64("node").alias("key"), "n", "low", "at.doc_id", "at.h"), "nodes")
    left = reps.select("key", "doc_id", "h")
    if sieve:
        left = left.join(sieved(reps, share, scratch), "key", "left_semi")
    ids = small(scratch.stage(left.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "ids"))
    texts = docs.withColumn("_h", F.xxhash64("text"))
    texts = texts.join(ids, texts["doc_id"].eqNullSafe(ids["_id"]) & texts["_h"].eqNullSafe(ids["_h"]), "left_semi")
    full = scratch.stage(whole_sets(texts, words), "sets")
    if full.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():  # rows that occur twice
        full = scratch.stage(full.dropDuplicates(["node"]), "sets")
    full = full.withColumn("key", F.xxhash64("node"))
    each = full.select("key", F.explode("tokens").alias("t"))
    df = scratch.stage(each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    met = each.join(df, "t").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("shared"))
    front = F.expr(f"CAST((n * {100 - share}) DIV 100 + 1 - (n - size(shared)) AS INT)")
    near = full.select("node", "key", "n").join(met, "key").withColumn("front", front).where("front > 0")
    near = near.select("node", "key", "n", F.col("shared.t").alias("tokens"), F.slice(F.col("shared.t"), F.lit(1), F.col("front")).alias("front"))
    near = scratch.stage(near, "near")
    scratch.drop(reps, full, df)
    return near


def grouped(near: DataFrame, scratch: Scratch) -> DataFrame:
    """Staged: key, n, hub (the leader's key) and group of each node that has a front shingle in common with another."""
    front = near.select("key", F.explode("front").alias("t"))
    hubs = scratch.stage(front.groupBy("t").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "hubs")
    most = front.join(hubs, "t").groupBy("key", "hub").agg(F.count(F.lit(1)).alias("c"))
    lead = most.groupBy("key").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    own = near.select("key", "n", F.size("tokens").alias("size"), (F.array_min("tokens") / float(1 << 64) + 0.5).alias("u"))
    placed = scratch.stage(own.join(lead, "key"), "placed")
    scratch.drop(hubs)
    parts = lambda *by: placed.groupBy(*by).agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("size") / TOKENS)).cast("int").alias("k"))
    k = scratch.stage(parts("hub"), "leaders")
    band = F.floor(F.col("u") * F.col("k")).cast("int")  # by the least hash: similar sets fall into one band
    placed = scratch.stage(placed.join(k, "hub").select("key", "n", "hub", "size", band.alias("band")), "banded")
    k = scratch.stage(parts("hub", "band"), "bands")
    group = F.xxhash64("hub", "band", F.pmod(F.xxhash64("key"), F.col("k")))
    return scratch.stage(placed.join(k, ["hub", "band"]).select("key", "n", "hub", "size", group.alias("gid")), "groups")


def verify(share: int):
    """Of a table (node, n, tokens, first): links among all rows if all are `first`, else between the rows that are and those that aren't."""

    def run(t: pa.Table) -> pa.Table:
        t, found = t.combine_chunks(), []
        left = t.column("first").to_numpy().astype(bool)
        if t.num_rows > 1 and left.any():
            column = t.column("tokens").chunk(0)
            flat, edge = column.flatten().to_numpy(), column.offsets.to_numpy()
            edge = edge - edge[0]
            found = link_groups(t.column("node").to_pylist(), t.column("n").to_numpy(), [flat[a:b] for a, b in zip(edge, edge[1:])], left, share)
        forget_unused()
        return pa.table({"node": pa.array([x for x, _ in found], pa.binary()), "hub": pa.array([y for _, y in found], pa.binary())})

    return run


def within_groups(near: DataFrame, groups: DataFrame, share: int) -> DataFrame:
    """Links inside of groups, as (node, hub); a group's leader, where it isn't a member, comes as a guest."""
    every = groups.select("gid", "key").unionByName(groups.select("gid", F.col("hub").alias("key"))).distinct()
    sent = near.select("key", "node", "n", "tokens").join(small(every), "key").select("gid", "node", "n", "tokens", F.lit(True).alias("first"))
    return sent.groupBy("gid").applyInArrow(verify(share), "node binary, hub binary")


def across_groups(near: DataFrame, groups: DataFrame, labels: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """Links between queries and the nodes of groups that aren't theirs, where their labels differ.

    A label of LARGE nodes or more has groups of its own; what is left of a group stays together. Of a small and a large label
    the small one's nodes are the queries, of two large ones the smaller one's: so a few odd texts beside a giant family ask
    its groups, and its nodes don't ask for them."""
    of = near.select("key", "node").join(labels, "node", "left").select("key", F.xxhash64(F.coalesce("label", "node")).alias("comp"))
    of = scratch.stage(of, "comps")
    count = scratch.stage(of.groupBy("comp").agg(F.count(F.lit(1)).alias("many")), "many")
    placed = groups.join(of, "key").join(count, "comp").withColumn("large", F.col("many") >= LARGE)
    placed = placed.select("key", "n", "comp", "many", "large", F.xxhash64("gid", F.when(F.col("large"), F.col("comp"))).alias("gid"))
    placed = small(scratch.stage(placed, "pure"))
    front = scratch.stage(near.select("key", F.explode("front").alias("t")).join(placed, "key"), "fronts")
    # The matrix, of the shingles that more than one label has.
    mixed = scratch.stage(front.groupBy("t").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("t"), "mixed")
    front = scratch.stage(front.join(mixed, "t", "left_semi"), "open")
    most = lambda c, to: F.max(c).alias(to)
    matrix = front.groupBy("t", F.col("gid").alias("to")).agg(F.min("n").alias("lo"), most("n", "hi"), F.min("comp").alias("a"), most("comp", "b"), most("many", "size"), most("large", "vast"))
    rank = lambda *c: F.struct(*(F.col(x) for x in c))
    within = F.when(F.col("large"), F.col("vast") & (rank("many", "comp") < rank("size", "a"))).otherwise(F.col("vast") | (F.col("gid") < F.col("to")) & ~((F.col("a") == F.col("b")) & (F.col("a") == F.col("comp"))))
    fits = within & (100 * F.col("hi") >= share * F.col("n")) & (share * F.col("lo") <= 100 * F.col("n"))
    asked = scratch.stage(front.join(scratch.stage(matrix, "matrix"), "t").where(fits).select("key", F.col("to").alias("gid")).distinct(), "asked")
    groups = placed.select("key", "gid")
    size = near.select("key", F.size("tokens").alias("size"))
    salts = asked.join(size, "key").groupBy("gid").agg(F.ceil(F.greatest(F.count(F.lit(1)) / QUERIES, F.sum("size") / TOKENS)).cast("int").alias("k"))
    salts = scratch.stage(salts, "salts")
    queries = asked.join(salts, "gid").select("key", "gid", F.pmod(F.xxhash64("key"), F.col("k")).cast("int").alias("salt"), F.lit(False).alias("first"))
    members = groups.join(salts, "gid").select("key", "gid", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(True).alias("first"))
    sent = near.select("key", "node", "n", "tokens").join(scratch.stage(queries.unionByName(members), "sent"), "key")
    return sent.groupBy("gid", "salt").applyInArrow(verify(share), "node binary, hub binary")


def classes(docs: DataFrame, words: int = WORDS, share: int = SHARE, sieve: bool = True) -> tuple[DataFrame, DataFrame]:
    """Staged: the rows (doc_id, hash of the text, n, node), and each node's label and component_id."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = plain(docs, doc_id=docs.schema["doc_id"].dataType.simpleString(), text="string")
    rows = scratch.stage(sketches(docs.withColumn("h", F.xxhash64("text")), words), "rows")
    near = fronts(docs, rows, words, share, sieve, scratch)
    groups = grouped(near, scratch)
    labels = components(within_groups(near, groups, share), scratch, "within")
    links = scratch.stage(across_groups(near, groups, labels, share, scratch), "across")
    if links.limit(1).count():
        up = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        edges = links.join(up("node"), "node", "left").join(up("hub"), "hub", "left")
        edges = edges.select(F.coalesce("node_label", "node").alias("node"), F.coalesce("hub_label", "hub").alias("hub")).where("node <> hub")
        both = edges.unionByName(edges.select(F.col("hub").alias("node"), "hub"))
        over = components(both, scratch, "labels").select(F.col("node").alias("label"), F.col("label").alias("over"))
        every = labels.unionByName(links.select("node", F.col("node").alias("label"))).unionByName(links.select(F.col("hub").alias("node"), F.col("hub").alias("label")))
        every = every.groupBy("node").agg(F.min(F.struct(F.col("label") == F.col("node"), "label"))["label"].alias("label"))  # those labelled before first
        labels = scratch.stage(every.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label")), "joined")
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    least = scratch.stage(least, "least")
    class_id = scratch.stage(least.groupBy("label").agg(F.min("least").alias("component_id")), "class")
    of = scratch.stage(least.join(class_id, "label").select("node", "label", "component_id"), "of")
    scratch.drop(near, groups, least, class_id)
    return rows.select("doc_id", "h", "n", "node"), of


def join(docs: DataFrame, words: int = WORDS, share: int = SHARE, sieve: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id for each row."""
    rows, of = classes(docs, words, share, sieve)
    out = rows.join(of, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def select(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """One row of each component, the least id (null last), with all columns; rows without words stay as they are."""
    scratch = Scratch(docs.sparkSession, "distinct")
    rows, of = classes(docs, words, share)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    least = scratch.stage(rows.groupBy("node").agg(F.min(key).alias("key")).join(of, "node").groupBy("label").agg(F.min("key").alias("best")), "least")
    every = rows.where("n > 0").groupBy("node", "doc_id", "h").agg(F.count(F.lit(1)).alias("times")).join(of.select("node", "label"), "node").join(least, "label")
    every = scratch.stage(every.select("doc_id", "h", "times", (key != F.col("best")).alias("goes")), "every")
    p = free_prefix(docs, "_j_")
    goes = small(every.where("goes").select(F.col("doc_id").alias(f"{p}id"), F.col("h").alias(f"{p}h")))
    left = docs.join(goes, docs["doc_id"].eqNullSafe(goes[f"{p}id"]) & F.xxhash64(docs["text"]).eqNullSafe(goes[f"{p}h"]), "left_anti")
    # Rows that are the same in id and text can't be told apart by that key; only where there are any, rows are compared.
    return left.dropDuplicates(["doc_id", "text"]) if every.where("not goes and times > 1").limit(1).count() else left
