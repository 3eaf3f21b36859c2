"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

import random
import re
import zlib

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def crc(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def odd_rows(n: int = 60, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    en, es = "the and of thing onth erea tion ing thha".split(), "ción que ñez de los mente ado gaña".split()
    rows = []
    for i in range(n):
        words = rng.choices(en if i % 3 else es, k=rng.randrange(1, 200))
        rows.append((i, " ".join(words).capitalize() + ".\nNew line  here", "en" if i % 3 else "es", f"src{i % 4}" if i % 7 else None))
    rows += [(1000, None, "en", "src0"), (1001, "", None, "src1"), (1002, " \t\n ", "en", None), (1003, "12 34 \x1c 5 6", None, "src9")]
    rows += [(1004, "word " * 5000, "en", "src0"), (1005, "a b c d e", "en", "src1"), (1006, "one", "es", "src2"), (None, "null id the and of thing", "en", "src2")]
    rows += [(1007, " ".join(f"{'w' * 30}{i % 4001}" for i in range(33_000)), "en", "src1")]  # beyond what is handled at once
    rows += [rows[5], rows[5], (rows[6][0], rows[7][1], "en", "src3")]  # repeated rows, and an id with two texts
    return rows


def odd(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    df = spark.createDataFrame(odd_rows() if rows is None else rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "1 as size", "'x' as digest", "0 as shard", "array(1) as words", "current_timestamp() as `a.b`", "1 as row", "1 as _q_n_words", "2 as _copies", "3 as _m_copies", "4 as _l_lang", "5 as _id", "6 as _j_h", "7 as `_Q_x`")


def empty(spark: SparkSession) -> DataFrame:
    return odd(spark, [])
