"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit for each
failed rule; a policy is a mask of rule bits, and policies have versions. Applying another policy, or
asking what each rule alone removes, then reads the ledger and never the texts.

Null and empty texts have no words: all measurements are 0 and `few_words` fails. Repeated rows get one
ledger row each; null ids stay null; other columns are ignored (select() keeps them, whatever their names). Very long texts are
measured whole, each in one task. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, annotate, free_prefix, map_slices, names, plain, starts, sums, windows, word_hashes, word_lists, worker_cache

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Beside those of its name: bytes of the longest word; words with a letter; occurrences of the most frequent word; different words;
#: lines with a word (n_lines), and those of them that end a sentence.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_digits", "n_longest", "n_letter_words",
    "n_top_word", "n_distinct", "n_ended",
)

#: Rule name -> condition of failure. The position is the bit; new rules come last.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 50 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "capitals": "100 * n_capitals > 60 * n_letters",
    "short_words": "word_chars < 4 * n_words",
    "long_words": "10 * word_chars > 75 * n_words",
    "longest_word": "n_longest > 30",
    "many_words": "n_words > 10000",
    "digits": "100 * n_digits > 5 * word_chars",
    "few_letters": "100 * n_letter_words < 80 * n_words",
    "top_word": "100 * n_top_word > 20 * n_words",
    "few_kinds": "100 * n_distinct < 40 * n_words",
    "unended_lines": "100 * n_ended < 20 * n_lines",
    "short_lines": "n_words < 4 * n_lines",
    "one_line": "n_lines < 2",
}
#: Policy -> version -> the rules that reject.
POLICIES: dict[str, dict[int, tuple[str, ...]]] = {
    "web": {1: ("few_words", "repeated_words"), 2: ("few_words", "repeated_words", "symbols", "repeated_lines", "capitals")},
    "strict": {1: tuple(RULES)},
}


@worker_cache
def char_kinds() -> np.ndarray:
    """For each code point 0, 1 for a letter of any script, 2 for a capital, 3 for a digit, 5 for a blank."""

    def kind(c: str) -> int:
        if c in BLANKS:
            return 5
        if c.isalpha():
            return 1 + c.isupper()
        return 3 * c.isdigit()

    return np.fromiter(map(kind, map(chr, range(0x110000))), np.uint8, 0x110000)


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    lists = word_lists(texts)
    h, counts = word_hashes(lists)
    out = {"n_words": counts}
    t = [x or "" for x in texts]
    n = len(t)
    size = np.fromiter(map(len, t), np.int64, n)
    kind = char_kinds()[np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), np.uint32)]
    out["word_chars"] = sums(kind != 5, size)
    for name, k in (("n_capitals", 2), ("n_digits", 3)):
        out[name] = sums(kind == k, size)
    letter = (kind == 1) | (kind == 2)
    out["n_letters"] = sums(letter, size)
    # Words with a letter: the letters that come first in their word.
    start = np.ones(len(kind), bool)
    start[1:] = (kind[:-1] == 5) | (np.repeat(np.arange(n), size)[1:] != np.repeat(np.arange(n), size)[:-1])
    word = np.cumsum(start)[letter]
    first = np.zeros(len(kind), bool)
    first[np.flatnonzero(letter)[np.diff(word, prepend=0) > 0]] = True
    out["n_letter_words"] = sums(first, size)
    out["n_symbols"] = np.fromiter((sum(map(x.count, SYMBOLS)) for x in t), np.int64, n)
    raw = [[y for y in x.split("\n") if y.strip(BLANKS)] for x in t]
    out["n_lines"] = np.fromiter(map(len, raw), np.int64, n)
    out["n_dup_lines"] = out["n_lines"] - np.fromiter((len(set(x)) for x in raw), np.int64, n)
    out["n_ended"] = np.fromiter((sum(y.rstrip(BLANKS).endswith((".", "!", "?", '"', "…", "。")) for y in x) for x in raw), np.int64, n)
    out["n_longest"] = np.fromiter((max(map(len, x), default=0) for x in lists), np.int64, n)
    # Words by text: different ones, and how often the most frequent one occurs.
    key = h ^ (np.repeat(np.arange(n, dtype=np.uint64), counts) * np.uint64(0x9E3779B97F4A7C15))
    _, at, times = np.unique(key, return_index=True, return_counts=True)
    text = np.repeat(np.arange(n), counts)[at]
    out["n_distinct"] = np.bincount(text, minlength=n).astype(np.int64)
    out["n_top_word"] = np.zeros(n, np.int64)
    np.maximum.at(out["n_top_word"], text, times)
    out["n_repeat_words"] = repeated(h, counts)
    return out


def repeated(h: np.ndarray, counts: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each text that lie in a window of `width` words found twice or more in it."""
    w = windows(h, width)
    if not len(w):
        return np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = doc[: len(w)] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    key = w[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    hit = at[order[twice]]
    edge[hit] += 1
    np.subtract.at(edge, hit + width, 1)
    return sums(np.cumsum(edge[:-1]) > 0, counts)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements (long) and fail_bits long: bit k is set if the k-th of RULES fails."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(m[k], pa.int64()) for k in MEASURES)], names=["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_slices(plain(docs, doc_id=kind, text="string"), run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in MEASURES))
    return out.withColumn("fail_bits", fail_bits())


def fail_bits(prefix: str = "") -> Column:
    """The bit pattern of a row of measurements, whose columns may have a prefix."""
    at = lambda rule: F.expr(re.sub(r"[a-z]\w*_\w+", lambda m: f"`{prefix}{m[0]}`", rule))
    bits = [F.when(at(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    return sum(bits[1:], bits[0]).cast("long")


def annotated(docs: DataFrame) -> tuple[DataFrame, str]:
    """All columns of the documents with the ledger's beside them, and the prefix of these names, which no other column has."""
    prefix = free_prefix(docs, "_q_")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        m = measure(batch.column("text").cast(pa.string()).to_pylist())
        return [pa.array(m[k], pa.int64()) for k in MEASURES]

    rows = annotate(docs, run, ", ".join(f"{prefix}{k} long" for k in MEASURES))
    return rows.withColumn(f"{prefix}fail_bits", fail_bits(prefix)), prefix


def select(docs: DataFrame, policy: str = "web", version: int | None = None) -> DataFrame:
    """The rows that a policy keeps, with all their columns. The ledger is written to the shared folder beside the rows, once,
    and the policy reads it there: no text is measured twice and no row is shuffled."""
    rows, prefix = annotated(docs)
    rows = Scratch(docs.sparkSession, "ledger").stage(rows, "ledger")
    return rows.where(F.col(f"{prefix}fail_bits").bitwiseAND(F.lit(mask(policy, version))) == 0).select(*names(docs))


def mask(policy: str = "web", version: int | None = None) -> int:
    versions = POLICIES[policy]
    return sum(1 << list(RULES).index(r) for r in versions[max(versions) if version is None else version])


def kept(policy: str = "web", version: int | None = None) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy, version))) == 0


def ablations(rows: DataFrame, policy: str = "web", version: int | None = None) -> DataFrame:
    """For each rule of a policy: failed (documents that fail it), alone (that no other rule of it rejects) and
    kept_without (what the policy without it keeps). One pass: ledger rows collapse to their bit patterns first."""
    m = mask(policy, version)
    rules = [(k, r) for k, r in enumerate(RULES) if m >> k & 1]
    seen = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    by = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << k).alias("bit")) for k, r in rules))).alias("r")
    rest = F.col("bits").bitwiseAND(F.lit(m) - F.col("r.bit"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return seen.select("bits", "n", by).groupBy(F.col("r.rule").alias("rule")).agg(total(hit).alias("failed"), total(hit & (rest == 0)).alias("alone"), total(rest == 0).alias("kept_without"))


def verdicts(docs: DataFrame, policy: str = "web", version: int | None = None) -> DataFrame:
    """The ledger with base_failed and kept."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("web", 1))) != 0
    return ledger(docs).withColumns({"base_failed": base, "kept": ~base & kept(policy, version)})
