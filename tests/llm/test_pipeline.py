from collections import Counter

import corpus_pipeline
from sparkwarden.llm import jaccard, rules

from .fixtures import SF, empty, odd
from .test_jaccard import brute


def steps(spark, docs, folder):
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.mode("overwrite").parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages(spark, tmp_path):
    for name, docs in (("odd", odd(spark)), ("real", spark.read.parquet(f"{SF}/documents.parquet"))):
        out = steps(spark, docs, f"{tmp_path}/{name}")
        for a in out[1:-1]:
            assert a.columns == docs.columns
        rows = [[(r["doc_id"], r["text"]) for r in x.collect()] for x in out[:-1]]
        kept = rules.verdicts(docs).where("kept").groupBy("doc_id").count().collect()
        assert Counter(i for i, _ in rows[1]) == {r[0]: r[1] for r in kept}
        assert set(rows[2]) <= set(rows[1]) and len(rows[2]) > 0.9 * len(rows[1])
        # one of each component of what came in, the least id
        least = {c for _, n, c in brute(rows[2]) if n}
        assert {i for i, _ in rows[3]} == least
        assert len(rows[3]) == len(set(rows[3]))
        assert set(rows[4]) <= set(rows[3]) and max(Counter(rows[4]).values()) <= 3
        pieces = out[-1].collect()
        whole = Counter()
        for p in pieces:
            whole[p["doc_id"]] += p["length"]
        assert set(whole) == {i for i, _ in rows[4]}


def test_run_is_the_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda rows: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, SF).collect()) == key(steps(spark, docs, tmp_path)[-1].collect())


def test_no_documents(spark, tmp_path):
    assert steps(spark, empty(spark), tmp_path)[-1].collect() == []


def test_repeated_rows_leave_one(spark):
    docs = odd(spark, [(1, "a b c d e f g", "en", "s"), (1, "a b c d e f g", "en", "s"), (2, "a b c d e f g", "en", "s"), (3, None, "en", "s"), (3, None, "en", "s"), (1, "other words here than those", "en", "s")])
    assert Counter((r["doc_id"], r["text"]) for r in jaccard.select(docs).collect())[(1, "a b c d e f g")] == 1
    assert {(r["doc_id"], r["text"]) for r in jaccard.select(docs).collect()} == {(1, "a b c d e f g"), (3, None), (1, "other words here than those")}
