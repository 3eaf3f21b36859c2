"""A content-addressed store of token ids.

A text's ids, with an end id, are cut into chunks where a rolling hash of the last few ids says so; equal runs of
ids in different texts thus give equal chunks. Layout of a store:

  chunks/     digest (16 bytes of BLAKE2b), n, ids: each distinct chunk once, ids little-endian, `width` bytes each
  recipes/    doc_id, start, n_tokens, digests (one after another), leaf: documents in ascending doc_id order, in
              files of ascending ranges; start is the number of ids before the document
  manifest/   level, node, hash: Merkle tree over the recipes' leaves, FAN children to a node; the top node is the root

A leaf is the BLAKE2b of a recipe's digests, so the root vouches for every id of every text. read() digests the stored
ids anew, rebuilds the leaves and compares: `verified` is false where anything differs. A text's crc32 is combined from
its chunks' crc32s, so reading back shuffles no ids.

Null texts are empty: the end id only. Null doc_ids come first, equal ids in the order of their recipes. A
text of any length is one task's, chunk by chunk. Extra columns of any name are left out. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import M1, M2, Scratch, map_batches, mix, plain, slices
from .tokens import encoder, with_end

TOKENIZER = "word_bpe_49k.json"
END = 2
#: Ids that the rolling hash sees; a cut comes once in AVERAGE ids, and at MOST ids at the latest.
SPAN, AVERAGE, MOST = 8, 512, 4096
FAN = 256
DIGEST = 16


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=DIGEST).digest()


def cuts(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin in all ids, and how many chunks each text has. The hash is a sum over the last SPAN ids of powers
    times spread ids; near a text's beginning it sees what stands before, so cuts there wait for SPAN ids."""
    v = mix(ids.astype(np.uint64) + np.uint64(1))
    h = np.zeros(len(ids), np.uint64)
    for k in range(SPAN):
        h[k:] += v[: len(v) - k] * np.uint64(pow(int(M1), k, 1 << 64))
    h = (h * M2) >> np.uint64(40)
    first = np.cumsum(counts) - counts
    place = np.arange(len(ids)) - np.repeat(first, counts)
    begins = np.zeros(len(ids) + 1, bool)
    begins[1:] = (h % np.uint64(AVERAGE) == 0) & (place >= SPAN - 1)
    begins = begins[:-1]
    begins[first[counts > 0]] = True
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, len(ids)))
    long = size > MOST
    if long.any():
        more = [np.arange(a, a + n, MOST)[1:] for a, n in zip(at[long], size[long])]
        at = np.sort(np.concatenate([at, *more]))
    owner = np.searchsorted(np.cumsum(counts), at, "right")
    return at, np.bincount(owner, minlength=len(counts))


def _matrix(n: int) -> list[int]:
    """What n further zero bytes do to a crc32, as 32 columns over GF(2)."""
    row = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        row = _square(row)  # one zero byte
    out = [1 << k for k in range(32)]
    while n:
        if n & 1:
            out = [_times(row, x) for x in out]
        row = _square(row)
        n >>= 1
    return out


def _times(m: list[int], v: int) -> int:
    out = 0
    for k in range(v.bit_length()):
        if v >> k & 1:
            out ^= m[k]
    return out


def _square(m: list[int]) -> list[int]:
    return [_times(m, x) for x in m]


class Crc:
    """crc32 of joined strings from their crc32s and lengths: GF(2) shifts, kept for lengths of powers of two."""

    def __init__(self) -> None:
        self.shift: list[list[list[int]]] = []

    def _tables(self, bit: int) -> list[list[int]]:
        while len(self.shift) <= bit:
            m, tables = _matrix(1 << len(self.shift)), []
            for b in range(4):  # by byte: 4 look-ups instead of 32
                t = [0] * 256
                for x in range(1, 256):
                    low = x & -x
                    t[x] = t[x ^ low] ^ m[8 * b + low.bit_length() - 1]
                tables.append(t)
            self.shift.append(tables)
        return self.shift[bit]

    def join(self, crc: int, nxt: int, size: int) -> int:
        bit = 0
        while size:
            if size & 1:
                t = self._tables(bit)
                crc = t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]
            size >>= 1
            bit += 1
        return crc ^ nxt


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, width: int = 2) -> str:
    """Writes a store of all documents to `path` and returns its Merkle root as hex. `width` 2 holds ids below 65536."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "store")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches):
            ids, counts = with_end(*encoder(tokenizer).encode(part.column("text")), end)
            if width == 2 and int(ids.max(initial=0)) > 0xFFFF:
                raise ValueError("ids of 65536 and more need width=4")
            at, per = cuts(ids, counts)
            raw = ids.astype(f"<u{width}").tobytes()
            edge = [*(width * at).tolist(), len(raw)]
            chunk = [raw[a:b] for a, b in zip(edge, edge[1:])]
            dig = [digest(c) for c in chunk]
            own = np.cumsum(per) - per
            recipe = [b"".join(dig[a : a + n]) for a, n in zip(own.tolist(), per.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(recipe, pa.binary()), pa.array(map(digest, recipe), pa.binary())] + [pa.nulls(len(per), t) for t in (pa.binary(), pa.int32(), pa.binary())] + [pa.array([0] * len(per), pa.int32())], names=names)
            if len(seen) > 1 << 17:
                seen.clear()
            new = {d: c for d, c in zip(dig, chunk) if d not in seen}  # what this task has sent it needn't send again
            seen.update(new)
            n = len(new)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, part.schema.field("doc_id").type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(list(new), pa.binary()), pa.array([len(c) // width for c in new.values()], pa.int32()), pa.array(list(new.values()), pa.binary()), pa.array([1] * n, pa.int32())], names=names)

    names = ["doc_id", "n_tokens", "digests", "leaf", "digest", "n", "ids", "kind"]
    staged = scratch.stage(map_batches(plain(docs, doc_id=kind, text="string"), run, f"doc_id {kind}, n_tokens long, digests binary, leaf binary, digest binary, n int, ids binary, kind int"), "cut", "kind")
    staged.where("kind = 1").groupBy("digest").agg(F.first("n").alias("n"), F.first("ids").alias("ids")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/chunks")
    laid = scratch.stage(staged.where("kind = 0").select("doc_id", "n_tokens", "digests", "leaf").orderBy("doc_id", "leaf").withColumn("_file", F.spark_partition_id()), "laid")
    # A row for each file, and in one place only these sums.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = laid.groupBy("_file").agg(F.sum("n_tokens").alias("_t"), F.count(F.lit(1)).alias("_c"))
    files = files.select("_file", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c0"))
    own = Window.partitionBy("_file").orderBy("doc_id", "leaf")
    numbered = laid.withColumns({"_own": F.coalesce(F.sum("n_tokens").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_nth": F.row_number().over(own) - 1}).join(F.broadcast(files), "_file")
    numbered = numbered.select("doc_id", (F.col("_t0") + F.col("_own")).cast("long").alias("start"), "n_tokens", "digests", "leaf", (F.col("_c0") + F.col("_nth")).cast("long").alias("node"))
    numbered.sortWithinPartitions("node").write.mode("overwrite").parquet(f"{path}/recipes")
    scratch.drop(staged, laid)
    return merkle(spark, path)


def _level(nodes: DataFrame, level: int) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))  # FAN at most
    joined = F.concat_ws("", F.transform(kids, lambda x: F.hex(x["hash"])))
    return nodes.groupBy(F.expr(f"node DIV {FAN}").alias("parent")).agg(F.unhex(F.sha2(joined, 256)).alias("hash")).select(F.lit(level).alias("level"), F.col("parent").alias("node"), "hash")


def merkle(spark: SparkSession, path: str) -> str:
    """Writes the tree over the recipes' leaves, level by level, and returns the root."""
    nodes = spark.read.parquet(f"{path}/recipes").select("node", F.col("leaf").alias("hash"))
    level = 1
    while True:
        _level(nodes, level).write.mode("overwrite").parquet(f"{path}/manifest/level={level}")
        nodes = spark.read.schema("level int, node long, hash binary").parquet(f"{path}/manifest/level={level}")
        if (n := nodes.count()) <= 1:
            break
        level += 1
    return bytes(nodes.first()["hash"]).hex() if n else ""


def read(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, verified of each document, from the files."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("ids").to_pylist()
            wide = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in raw]
            ok = [digest(x) == d and 4 * n == len(w) for x, w, d, n in zip(raw, wide, b.column("digest").to_pylist(), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(list(map(zlib.crc32, wide)), pa.int64()), pa.array([len(w) // 4 for w in wide], pa.int64()), pa.array(ok)], names=["digest", "crc", "size", "ok"])

    chunks = spark.read.parquet(f"{path}/chunks").select("digest", "n", "ids")
    chunks = map_batches(chunks, stored, "digest binary, crc long, size long, ok boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    many = F.expr(f"transform(sequence(0, length(digests) DIV {DIGEST} - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")
    parts = recipes.select("node", F.posexplode(many).alias("pos", "digest")).join(chunks, "digest", "left")
    lists = parts.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "crc", "size", F.coalesce("ok", F.lit(False)).alias("ok"), "digest"))).alias("parts"))
    rows = recipes.select("node", "doc_id", "start", "n_tokens", "leaf").join(lists, "node")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc()
        for b in batches:
            out, good = [], []
            flat = b.column("parts").flatten()
            f = {k: flat.field(k).to_pylist() for k in ("crc", "size", "ok", "digest")}
            edge = b.column("parts").offsets.to_pylist()
            edge = [e - edge[0] for e in edge]
            for a, z, n, leaf in zip(edge, edge[1:], b.column("n_tokens").to_pylist(), b.column("leaf").to_pylist()):
                ok = all(f["ok"][a:z])
                c = 0
                if ok:
                    for x, s in zip(f["crc"][a:z], f["size"][a:z]):
                        c = crc.join(c, x, 4 * s)
                    ok = sum(f["size"][a:z]) == n and digest(b"".join(f["digest"][a:z])) == leaf
                out.append(c)
                good.append(ok)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(out, pa.int64()), pa.array(good)], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return map_batches(rows, combine, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, verified boolean")


def load(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids array<int>: the texts' ids themselves, rebuilt from recipes and chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    many = F.expr(f"transform(sequence(0, length(digests) DIV {DIGEST} - 1), i -> substring(digests, i * {DIGEST} + 1, {DIGEST}))")
    parts = recipes.select("node", "doc_id", "start", F.posexplode(many).alias("pos", "digest")).join(spark.read.parquet(f"{path}/chunks").select("digest", "ids"), "digest")
    raw = parts.groupBy("node", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    kind = recipes.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in x), f"<u{width}").astype(np.int32) for x in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return map_batches(raw, run, f"doc_id {kind}, start long, ids array<int>")
