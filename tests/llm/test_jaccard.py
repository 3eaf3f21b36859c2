import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkwarden.llm import jaccard

from .fixtures import BLANK, empty, odd, odd_rows


def shingles(text):
    w = BLANK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Counter of (doc_id, n_shingles, component_id), all pairs that share a shingle compared."""
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = Counter((a, b) for v in at.values() for k, a in enumerate(v) for b in v[k + 1 :])
    for (a, b), n in pairs.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)].append(d)
    return Counter((d, len(sets[i]), min(least[top(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows))


def families(n=400, seed=0):
    """Near copies with more and more edits, passages that many texts share, and chains at the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(40)]
    rows, base = [], [[word() for _ in range(rng.choice([8, 40, 120, 300]))] for _ in range(12)]
    for i in range(n):
        if i % 3 == 0:
            w = [word() for _ in range(rng.randrange(10, 200))]
        else:
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 1 + len(w) // 12)):
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        rows.append((i, " ".join(w)))
    chain = [word() for _ in range(104)]
    for k in range(12):  # each shares 100 - 14 shingles or so with the next
        rows.append((n + k, " ".join(chain[2 * k :] + [word() for _ in range(2 * k)])))
    return rows


@pytest.mark.parametrize("seed", [0, 1])
def test_families(spark, seed):
    rows = families(seed=seed)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("limits", [(256, 1 << 18, 256), (5, 600, 3)])
def test_without_the_sieve_and_in_small_groups(spark, monkeypatch, limits):
    for name, x in zip(("GROUP", "TOKENS", "QUERIES"), limits):
        monkeypatch.setattr(jaccard, name, x)
    rows = families(seed=2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.join(df, sieve=limits[0] == 5).collect())) == brute(rows)


def test_passages_shared_by_many(spark, monkeypatch):
    """Texts made of three of twenty passages: every shingle is common, hardly any pair links, and groups meet across."""
    for name, x in (("GROUP", 8), ("QUERIES", 4)):
        monkeypatch.setattr(jaccard, name, x)
    rng = random.Random(5)
    passages = [" ".join(f"p{i}x{rng.randrange(10**6)}" for _ in range(30)) for i in range(20)]
    rows = [(i, " ".join(rng.sample(passages, 3 if i % 5 else 6))) for i in range(250)]
    rows += [(i, rows[i - 250][1] + f" one two {i}") for i in range(250, 330)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_pages_of_one_template(spark, monkeypatch):
    """5,000 pages share a template that is 70 % of each; only edited copies link. Pairs opened stay far from all pairs."""
    rng = random.Random(6)
    template = [f"t{k}" for k in range(110)]
    rows = []
    for i in range(5000):
        own = [f"w{rng.randrange(10**9)}" for _ in range(40)] if i % 50 or not i else rows[-1][1].split()[110:149] + ["x"]
        rows.append((i, " ".join(template + own)))
    counted = []
    real = jaccard.grouped
    monkeypatch.setattr(jaccard, "grouped", lambda near, *a: counted.append(near.count()) or real(near, *a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - 1 if i and i % 50 == 0 else i for i in range(5000)}
    assert counted == [198]  # pages without a partner send no sets


def test_large_family(spark):
    """More near copies than one group holds, besides many exact ones."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(999)}" for _ in range(150)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(5000 + i, " ".join(base)) for i in range(300)]
    assert Counter(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_small_sets_with_partners_beyond_the_sketch(spark):
    """Sets of 49 to 64 shingles inside sets of 65 to 85, of which the sieve sees 64: all at or just above the threshold."""
    rng = random.Random(8)
    rows = []
    for n in range(49, 65):
        for m in range(65, 4 * n // 3 + 1):
            for _ in range(3):
                w = [f"w{rng.randrange(10**9)}" for _ in range(m + 4)]
                rows += [(len(rows), " ".join(w[: n + 4])), (len(rows) + 1, " ".join(w))]
    got = Counter(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)
    assert all(c == d - d % 2 for d, _, c in got)


def test_odd(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(None, "just one null id text here now"), (None, None)]
    df = odd(spark, [(*r, "en", "s") for r in rows])
    assert Counter(map(tuple, jaccard.join(df).collect())) == brute(rows)
    assert jaccard.join(empty(spark)).collect() == []


def test_real(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, jaccard.join(docs).collect())) == brute(rows)


def test_two_groups_alone_and_across():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 40, 200)
    sets = [np.unique(np.concatenate([base[: 200 - k], rng.integers(0, 1 << 40, k)])) for k in range(0, 60, 3)]
    nodes, sizes = [bytes([i]) for i in range(len(sets))], np.array([len(s) for s in sets])
    left = np.arange(len(sets)) % 2 == 0

    def links(ok):
        return {(i, j) for i in range(len(sets)) for j in range(i) if ok(i, j) and 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (sizes[i] + sizes[j] - n)}

    for side, ok in ((left, lambda i, j: left[i] != left[j]), (np.ones(len(sets), bool), lambda i, j: True)):
        got = jaccard.link_groups(nodes, sizes, sets, side)
        seen = {x[0] for x, _ in got}
        assert seen == {i for p in links(ok) for i in p}
