"""Line deduplication over levelled sorted runs of line hashes, all of it DataFrame functions.

Documents come in batches, those with the largest ids first. A run is a table of line hashes, dealt into buckets by hash and sorted
inside of each, with the number of documents that hold the line and, in the run where the line came first, the largest of their
ids. A batch counts its own lines, merge-anti-joins them with the runs at hand, which tells the lines that no later document
holds, and adds its counts as a run of level 0. Two runs of a level are merged into one of the next, bucket by bucket without a
shuffle, so B batches leave at most log2(B) + 1 runs. Where all batches are in, the last merge has each line's documents and keeper;
the lines of each document that are to go are found by a join with that run. Lines that more than a 1/HEAVY of all
occurrences belong to are fewer than HEAVY, whatever the table's size: these are broadcast, so that no key of the other join is hot.

Null texts count as empty: one empty line. Each row counts as a document, repeated rows and rows of one id too; all rows of the largest id keep their
lines, and so do several equal lines of it. Rows with a null id come below all others, as one id. Texts of any length are taken whole,
each by the one task that reads it. Ids that aren't numbers make one batch. Extra columns of any name are left out. Empty
tables give no rows. Lines are told apart by the 128 bits of their keys' MD5. Buckets are as many as the session's spark.sql.shuffle.partitions,
which should follow the table's size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of the shortest key that counts, and documents that must hold it.
LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES = 4
HEAVY = 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(text: Column, least: int = LEAST_CHARS) -> Column:
    """For each line the MD5 of its key, as hexadecimals, or null where the key is shorter than `least`."""
    keys = F.transform(lines_of(text), lambda x: F.translate(F.btrim(x, F.lit(BLANKS)), UPPER, LOWER))
    return F.transform(keys, lambda k: F.when(F.length(k) >= least, F.md5(k.cast("binary"))))


class Runs:
    """The runs so far, by level; each has h, docs and keeper (null but where the line came first)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.n = spark, root, 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, DataFrame] = {}

    def _write(self, rows: DataFrame) -> DataFrame:
        """As a bucketed and sorted table in the shared folder; the catalogue needs its name only until the plan that reads it is made."""
        self.n += 1
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/run-{self.n}")
        writer.bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        found = self.spark.read.table(name)
        found.schema
        self.spark.sql(f"DROP TABLE {name}")  # the files stay
        return found

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Of the keys h those that no run has."""
        for run in self.levels.values():
            keys = keys.join(run.select("h").hint("merge"), "h", "left_anti")
        return keys

    def add(self, own: DataFrame) -> None:
        """`own`: h, docs and keeper of a batch whose ids are all below those of earlier batches."""
        new = self.fresh(own.select("h")).withColumn("new", F.lit(True))
        marked = own.join(new.hint("merge"), "h", "left") if self.levels else own.withColumn("new", F.lit(True))
        run, level = self._write(marked.select("h", "docs", F.when(F.col("new"), F.col("keeper")).alias("keeper"))), 0
        while level in self.levels:
            run, level = self._write(merged(self.levels.pop(level), run)), level + 1
        self.levels[level] = run

    def all(self) -> DataFrame:
        """One run of all."""
        run, *more = self.levels.values()
        for other in more:
            run = self._write(merged(run, other))
        self.levels = {max(self.levels): run}
        return run


def merged(one: DataFrame, two: DataFrame) -> DataFrame:
    """Two runs as one: their buckets are joined in order of the hashes, without a shuffle. A line has its keeper in one of them only."""
    a = one.select("h", F.col("docs").alias("d1"), F.col("keeper").alias("k1"))
    b = two.select("h", F.col("docs").alias("d2"), F.col("keeper").alias("k2")).hint("merge")
    docs = F.coalesce("d1", F.lit(0)) + F.coalesce("d2", F.lit(0))
    return a.join(b, "h", "full_outer").select("h", docs.cast("long").alias("docs"), F.coalesce("k1", "k2").alias("keeper"))


def batch_of(docs: DataFrame, batches: int) -> Column:
    """The batch of each row by its doc_id: 0 has the largest, nulls are in the last."""
    if batches < 2 or not isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        return F.lit(0)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000)).first()[0] or []
    below = sum((F.when(F.col("doc_id") < F.lit(c), 1).otherwise(0) for c in set(cuts)), F.lit(0))
    return F.when(F.col("doc_id").isNull(), F.lit(batches - 1)).otherwise(below).cast("int")


def dedupe(docs: DataFrame, batches: int = BATCHES, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text without the lines that go, n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("t"), hashes(F.col("text"), least_chars).alias("keys"), batch_of(docs, batches).alias("batch"))
    keyed = scratch.stage(keyed.where(F.exists("keys", lambda k: k.isNotNull())), "keys", "batch")
    runs = Runs(spark, scratch.root)
    for b in range(max(1, batches)):
        lines = keyed.where(F.col("batch") == b).select("doc_id", F.explode(F.array_distinct(F.array_compact("keys"))).alias("k"))
        runs.add(lines.groupBy(F.unhex("k").alias("h")).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper")))
    hot = runs.all().where(F.col("docs") >= least_docs)
    most = (hot.agg(F.sum("docs")).first()[0] or 0) / HEAVY
    lines = keyed.select("doc_id", "t", F.posexplode("keys").alias("pos", "k")).where(F.col("k").isNotNull())
    lines = lines.select("doc_id", "t", "pos", F.unhex("k").alias("h"))
    heavy = F.broadcast(hot.where(F.col("docs") > most).select("h", F.col("keeper").alias("keeper1"), F.lit(True).alias("heavy")))
    # What is settled by the heavy lines is spread by itself and meets no light one.
    own = F.concat(F.lit("settled already: "), F.xxhash64("doc_id", "t", "pos").cast("string"))  # longer than any hash
    spread = F.when(F.col("heavy"), own.cast("binary")).otherwise(F.col("h"))
    lines = lines.join(heavy, "h", "left").withColumn("h", spread)
    light = hot.where(F.col("docs") <= most).select("h", F.col("keeper").alias("keeper2"), F.lit(True).alias("light"))
    lines = lines.join(light.hint("merge"), "h", "left")
    gone = F.when(F.col("heavy"), ~F.col("doc_id").eqNullSafe(F.col("keeper1"))).when(F.col("light"), ~F.col("doc_id").eqNullSafe(F.col("keeper2")))
    drops = lines.where(gone).groupBy(F.col("doc_id").alias("id"), F.col("t").alias("of")).agg(F.collect_set("pos").alias("gone"))
    # Lines are cut before the join, so that none is cut again for each place that is looked up.
    whole = docs.select("doc_id", F.xxhash64("text").alias("t"), lines_of(F.col("text")).alias("lines"))
    both = whole.join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("of")), "left")
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stays, lambda i: F.get("lines", i)))
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return both.select("doc_id", F.array_join(left, "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), dropped.alias("n_dropped"))
