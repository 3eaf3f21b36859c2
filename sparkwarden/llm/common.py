"""What the training-data operators share: reading, staging in the shared folder, batches of text."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once in a Python worker, so that memory doesn't follow the batch size.
SLICE_BYTES = 1 << 20
#: Bytes of a batch on its way to Python, where the session leaves Spark's own 64 MB; JVM and worker each hold a batch or two.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set and the master is local (tests, one machine), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all of {master} share")
        found = "/tmp/sparkwarden-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES in this session, unless it has a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("64MB", "67108864b", "67108864"):
        spark.conf.set(key, BATCH_BYTES)


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors and are read with column pruning."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        self.n += 1
        path = self.path(f"{name}-{self.n}")
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes staged tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for f in {x.rsplit("/", 1)[0] for df in frames for x in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(conf).delete(p, True)


#: Rows of ids that may be broadcast, and their bytes; beyond that the join is a sort-merge join.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20


def small(df: DataFrame) -> DataFrame:
    """Marks a staged table of ids for broadcasting if its rows and bytes have been counted to be few."""
    varying = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = sum(varying, F.lit(16 + 8 * len(df.columns)))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


_kept: dict[tuple, object] = {}
_used: set[tuple] = set()


def worker_cache(fn: Callable) -> Callable:
    """Like functools.cache, but a Python worker lets go of what its last task of batches didn't use (see forget_unused)."""

    @functools.wraps(fn)
    def get(*args: object) -> object:
        key = (fn.__module__, fn.__qualname__, args)
        _used.add(key)
        if key not in _kept:
            _kept[key] = fn(*args)
        return _kept[key]

    return get


def forget_unused() -> None:
    """At the end of a task: models and chunks kept for other operators would fill a worker that Spark uses again."""
    for key in set(_kept) - _used:
        del _kept[key]
    _used.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
        trim(0)


@functools.cache
def one_blas_thread() -> None:
    """Once in a worker: numpy's OpenBLAS on one thread. Spark runs a worker for each core and lets each start a thread for every core,
    which wait for one another in busy loops over the small matrices used here."""
    try:
        with open("/proc/self/maps") as maps:
            found = {line.split()[-1] for line in maps if "openblas" in line}
    except OSError:  # not Linux: as Spark set it
        return
    for path in found:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function over batches that leaves the worker without what the task hasn't used."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        try:
            yield from run(batches)
        finally:
            forget_unused()

    return tidied


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in small batches, tidied up after each task."""
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def annotate(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: str, column: str = "text") -> DataFrame:
    """All columns of `df`, as they are, and the columns that `fn` makes of them; the new names must be free."""

    own, new = df.columns, [f.split()[0] for f in fields.split(", ")]
    within = [f"_{k}" for k in range(len(own))]  # mapInArrow can't take names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, within[own.index(column)]):
            yield pa.RecordBatch.from_arrays([*part.columns, *fn(part.rename_columns(own))], names=[*own, *new])

    return map_batches(df.toDF(*within), run, T.StructType([*df.schema.fields, *T._parse_datatype_string(fields).fields]))


def free_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix, with as many more underscores as it takes that no column's name begins with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def names(df: DataFrame) -> list[str]:
    """Column names that select() takes as they are, dots and all."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]


def plain(docs: DataFrame, **defaults: str) -> DataFrame:
    """Only the named columns, with their types; extra columns of any name are left out."""
    return docs.select(*(F.col(f"`{c}`").cast(kind).alias(c) for c, kind in defaults.items()))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the text of each part has about `most` bytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) // most).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text") -> DataFrame:
    """mapInArrow of `fn` over bounded parts of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield fn(part)

    return map_batches(df, run, schema)


def crc_bucket(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def word_lists(texts: list[str | None], lower: bool = False) -> list[list[bytes]]:
    """bytes.split() cuts at exactly the six ASCII blanks, and bytes.lower() changes exactly A-Z."""
    if lower:
        return [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    return [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts (binary, A-Z lower-cased), the place there of each word, and the number of words of each text;
    an empty word ends each text. Arrow's kernels cut at the six ASCII blanks and change A-Z only."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    low = pc.binary_join_element_wise(low, pc.if_else(pc.equal(pc.binary_length(low), 0), "", " "), "")  # after the last blank comes the empty word
    lists = pc.ascii_split_whitespace(low)
    coded = lists.flatten().dictionary_encode()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), counts


def word_hashes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Stable 64-bit hashes of all words, one after another, and the number of words of each text."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    seen: dict[bytes, int] = {}
    flat = [w for x in lists for w in x]
    for w in set(flat):
        seen[w] = h(w)
    return np.fromiter(map(seen.__getitem__, flat), np.uint64, len(flat)), counts


M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words; the order within the run counts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mix(h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
    return mix(out)


def starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of `values` for each run of the given lengths (empty runs: 0)."""
    c = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return c[ends] - c[ends - counts]


@functools.cache
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
