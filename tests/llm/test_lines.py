"""Line deduplication against plain Python, and its runs by themselves."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkwarden.llm import lines
from sparkwarden.llm.common import Scratch

from .fixtures import SF, empty, odd, odd_rows

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(lines.UPPER, lines.LOWER)


def brute(rows, least_chars=20, least_docs=3):
    held, key = defaultdict(set), lambda x: x.strip(STRIP).translate(LOWER)
    for n, (i, text) in enumerate(rows):
        for x in (text or "").split("\n"):
            if len(key(x)) >= least_chars:
                held[key(x)].add(((i is not None, i if i is not None else 0), n))
    keeper = {k: max(v)[0] for k, v in held.items() if len(v) >= least_docs}
    out = []
    for i, text in rows:
        own = (i is not None, i if i is not None else 0)
        whole = (text or "").split("\n")
        left = [x for x in whole if keeper.get(key(x), own) == own]
        out.append((i, len(whole), len(whole) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


def found(df, **options):
    rows = lines.dedupe(df, **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256))
    return Counter(map(tuple, rows.collect()))


def test_odd(spark):
    common = "A line that MANY documents hold"
    rows = odd_rows() + [
        (2000 + i, f"{' ' * i}{common.upper() if i % 2 else common}\t\nown {i}\n\nÀ short one\n{common}", "en", "s") for i in range(9)
    ]
    rows += [(None, common, "en", "s"), (3000, "x" * (3 << 20) + f"\n{common}\n", "en", "s"), (3001, "\n", "en", "s"), (3002, f"{common}\r", None, None)]
    rows += [(i, "É" * 19 + f"\n{'É' * 20}\nÉ{'é' * 19}", "en", "s") for i in range(4000, 4004)]
    got = found(odd(spark, rows))
    assert got == brute([r[:2] for r in rows])
    assert lines.dedupe(empty(spark)).collect() == []
    assert got == found(odd(spark, rows), batches=1) == found(odd(spark, rows), batches=7)


def test_ids_of_other_kinds(spark):
    rows = [(f"http://x/{i}", "the same line in all of these\n" + "z" * (i % 30)) for i in range(40)]
    got = found(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sum(n for _, _, n, _ in got) == 39 and {r[0] for r in got if not r[2]} == {"http://x/9"}


def test_real_and_light(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert found(df) == want
    monkeypatch.setattr(lines, "HEAVY", 3)  # most lines go by the other join then
    assert found(df) == want


def test_runs(spark):
    rng = random.Random(5)
    scratch = Scratch(spark, "runs")
    runs = lines.Runs(spark, scratch.root)
    seen, docs = {}, Counter()
    for b in range(6):
        own = {bytes([rng.randrange(30)]): (rng.randrange(1, 4), 100 - b) for _ in range(12)}
        df = spark.createDataFrame([(k, *v) for k, v in own.items()], "h binary, docs long, keeper long")
        got = {bytes(r.h) for r in runs.fresh(df.select("h")).collect()}
        assert got == own.keys() - seen.keys()
        runs.add(df)
        for k, (n, keeper) in own.items():
            docs[k] += n
            seen.setdefault(k, keeper)
        assert sorted(runs.levels) == [i for i in range(4) if (b + 1) >> i & 1]
    whole = runs.all()
    assert {(bytes(r.h), r.docs, r.keeper) for r in whole.collect()} == {(k, docs[k], seen[k]) for k in seen}
    plan = lines.merged(whole, whole)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_no_python_on_the_way(spark):
    plan = lines.dedupe(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_texts_of_very_many_lines(spark):
    """Work follows the number of lines: texts of 200,000 lines, of which all or half go."""
    many = [f"line number {i} that is long enough" for i in range(200_000)]
    rows = [(1, "\n".join(many)), (2, "\n".join(many)), (3, "\n".join(many[::2])), (4, "\n".join([many[0]] * 200_000))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
