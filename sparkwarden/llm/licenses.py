"""License scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Lines of a file, its paragraphs (lines up to one without words, comment signs aside) and the file as a whole are sparse TF-IDF
vectors; idf comes from the templates, and words that no template has weigh most. A line or paragraph of which the whole, or a
run of known words, has a cosine to a template of `least` or more is a header of that licence. A file is a licence
file of its directory if its name says so (LICENSE, COPYING, ...) and it has a header, or if the whole text reaches `whole`. The long
licences (texts/*.txt, with and without what follows their terms) are templates for whole texts only, by themselves: a text that reaches LONG is that
licence, whatever others it mentions, and a licence file.
Files without a licence of their own take that of the nearest directory above them that has a licence file.

Inheritance is settled for directories, not files: each directory looks its ancestors up in the table of licence files by a
join on the path, and files then join their own directory, so no join of files meets a key that others share. The root, which is above
every directory, has one licence at most; it is taken to the driver instead of being looked up.

Null and empty texts have no licence of their own. Null paths stand at the root. Ties go to the template first in the
list; two licence files of a directory: the higher score, then the lower path, then the lower licence. Repeated rows each get a
row. Very long texts are scanned whole; extra columns of any name are left out.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_slices
from .templates import TEMPLATES, long_texts

STOP = frozenset(b"the of is this to a an and or in with by are be any you may not that for on at as it".split())
#: Punctuation to blanks, but for dots and signs inside names, and A-Z to a-z.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c in b"\n.-+" or c >= 128 else 32 for c in range(256))
NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([._-][^/]*)?$"
LEAST, WHOLE, LONG = 0.72, 0.6, 0.9
#: Words that a text needs to be held against the long licences.
LONG_WORDS = 300


def words(line: bytes) -> list[bytes]:
    """Words without stop words; a dot stays inside of a number only."""
    out = (w.strip(b".-+") for w in line.split())
    return [w for w in out if w and w not in STOP]


def bag(text: str) -> list[bytes]:
    return words(text.encode("utf-8", "surrogatepass").translate(TABLE).replace(b"\n", b" "))


Model = tuple[dict[bytes, int], np.ndarray, float, np.ndarray]


def weighed(templates: list[tuple[str, str]]) -> Model:
    """The templates' words, their idf, that of other words, and the unit vectors [word, template]."""
    docs = [Counter(bag(t)) for _, t in templates]
    df = Counter(w for d in docs for w in d)
    place = {w: k for k, w in enumerate(df)}
    idf = np.array([1 + math.log((1 + len(docs)) / (1 + n)) for n in df.values()])
    rows = np.zeros((len(df), len(docs)))
    for j, d in enumerate(docs):
        for w, n in d.items():
            rows[place[w], j] = n * idf[place[w]]
    return place, idf, 1 + math.log(1 + len(docs)), rows / np.sqrt((rows**2).sum(0))


@functools.cache
def model() -> Model:
    return weighed(TEMPLATES)


@functools.cache
def long_model() -> tuple[list[str], Model]:
    texts = long_texts()
    return [name for name, _ in texts], weighed(texts)


def cosine(counts: Counter[bytes], to: Model | None = None) -> tuple[float, int]:
    """The best cosine of a bag of words to a template, and the template."""
    place, idf, other, rows = to or model()
    at = [place[w] for w in counts if w in place]
    if not at:
        return 0.0, 0
    x = np.array([n for w, n in counts.items() if w in place]) * idf[at]
    norm = math.sqrt(float(x @ x) + other**2 * sum(n * n for w, n in counts.items() if w not in place))
    s = x @ rows[at] / norm
    best = int(s.argmax())
    best = int(np.flatnonzero(s >= s[best] - 1e-12)[0])  # a tie goes to the first
    return float(s[best]), best


def scan(text: str | None) -> tuple[str | None, float, float]:
    """Licence of the best header, its score, and the cosine of the whole text."""
    if not text:
        return None, 0.0, 0.0
    place = model()[0]
    best, at, near, paragraph = 0.0, 0, False, []
    raw = text.encode("utf-8", "surrogatepass").translate(TABLE)

    def see(ws: list[bytes]) -> None:
        nonlocal best, at
        # Words that no template has weigh most, so a sentence among other words is found by its run of known ones.
        for part in (ws, *(r for r in runs(ws, place) if len(r) < len(ws))):
            s, k = cosine(Counter(part))
            if s > best + 1e-12 or s > best - 1e-12 and k < at:
                best, at = s, k

    for line in [*raw.split(b"\n"), b""]:
        if ws := words(line):
            if len(ws) > 1 and not place.keys().isdisjoint(ws):
                near = True
                see(ws)
            paragraph.append(ws)
        elif paragraph:
            if len(paragraph) > 1 and not all(map(place.keys().isdisjoint, paragraph)):
                see([w for x in paragraph for w in x])
            paragraph = []
    if not near:
        return None, 0.0, 0.0
    counts = Counter(words(raw.replace(b"\n", b" ")))
    if counts.total() >= LONG_WORDS:
        long_names, long = long_model()
        score, k = cosine(counts, long)
        if score >= LONG:
            return long_names[k], round(score, 12), round(score, 12)
    whole, k = cosine(counts)
    if whole >= WHOLE and whole > best:
        best, at = whole, k
    return TEMPLATES[at][0], round(best, 12), round(whole, 12)  # so that equal wordings tie


def runs(ws: list[bytes], known: dict[bytes, int]) -> list[list[bytes]]:
    """Runs of at least two words that templates have: a sentence within a longer line."""
    out, run = [], []
    for w in [*ws, b""]:
        if w in known:
            run.append(w)
        else:
            if len(run) > 1:
                out.append(run)
            run = []
    return out


def directories(path: Column) -> Column:
    """All directories above a path, nearest first, the root ("") last."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array(F.lit("")))


def inherit(files: DataFrame, least: float = LEAST, whole: float = WHOLE) -> DataFrame:
    """For files (path, text, any key column `doc_id`): doc_id, path, license, score, kind (file, header, inherited or null) and
    license_dir, the directory that it is inherited from."""
    scratch = Scratch(files.sparkSession, "license")
    id_kind = files.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [scan(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found]), pa.array([x[2] for x in found])], names=["doc_id", "path", "own", "score", "whole"])

    rows = files.select("doc_id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("text").cast("string").alias("text"))
    rows = map_slices(rows, run, f"doc_id {id_kind}, path string, own string, score double, whole double")
    has = F.col("score") >= least
    is_file = has & (F.col("path").rlike(NAMES) | (F.col("whole") >= whole))
    rows = scratch.stage(rows.select("doc_id", "path", F.when(has, F.col("own")).alias("own"), "score", F.when(is_file, "file").when(has, "header").alias("kind"), F.element_at(directories(F.col("path")), 1).alias("dir")), "scan")
    best = rows.where("kind = 'file'").groupBy("dir").agg(F.min_by(F.struct("own", "score"), F.struct(-F.col("score"), F.col("path"), F.col("own"))).alias("best")).select(F.col("dir").alias("at"), F.col("best.own").alias("license"), F.col("best.score").alias("dir_score"))
    best = scratch.stage(best, "best")
    every = scratch.stage(rows.select("dir").distinct(), "dirs")
    # The root's licence is one row; every other directory is looked up by those below it only.
    root = best.where("at = ''").first()
    above = F.filter(F.concat(F.array("dir"), F.when(F.col("dir") != "", directories(F.col("dir"))).otherwise(F.array().cast("array<string>"))), lambda d: d != "")
    up = every.select("dir", F.posexplode(above).alias("far", "at"))
    near = up.join(best, "at").groupBy("dir").agg(F.min_by(F.struct("at", "license", "dir_score"), "far").alias("up"))
    near = scratch.stage(near.select("dir", F.col("up.at").alias("license_dir"), F.col("up.license").alias("up_license"), F.col("up.dir_score").alias("up_score")), "near")
    out = rows.join(near, "dir", "left")
    if root:
        here = F.col("license_dir").isNull()
        out = out.withColumns({"up_license": F.when(here, root["license"]).otherwise(F.col("up_license")), "up_score": F.when(here, root["dir_score"]).otherwise(F.col("up_score")), "license_dir": F.coalesce("license_dir", F.lit(""))})
    own = F.col("kind").isNotNull()
    got = F.col("up_license").isNotNull()
    return out.select("doc_id", "path", F.when(own, F.col("own")).otherwise(F.col("up_license")).alias("license"), F.when(own, F.col("score")).when(got, F.col("up_score")).alias("score"), F.when(own, F.col("kind")).when(got, "inherited").alias("kind"), F.when(~own & got, F.col("license_dir")).alias("license_dir"))


def document_paths(docs: DataFrame, width: int = 64) -> DataFrame:
    """The documents table as a tree of files: source/<doc_id div width>/doc_id (ids that aren't whole numbers: by a hash)."""
    whole = docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    folder = F.expr(f"CAST(doc_id DIV {width} AS STRING)") if whole else F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("string"))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce(F.col("source").cast("string"), F.lit("_")), F.coalesce(folder, F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_"))).alias("path"), "text")
