"""Whitening against numpy and exact integers."""

import math

import numpy as np
import pytest

from sparkwarden.llm import whitening

from .fixtures import SF


def brute(rows, k=16):
    """For each row (vec_id, deviation), axes up to sign, and explained."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    xs = [(i, [math.floor(64 * c) + 10**6 for c in [*v, *[0.0] * (width - len(v))]]) for i, v in good]
    fit = sorted({tuple(x) for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    all_ = np.array([[(n * a - b) / n for a, b in zip(x, s)] for _, x in xs])
    return [(i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in xs], all_ @ w / np.sqrt(e), e / (centred**2).sum() * n, n


def compare(got, rows):
    exact, white, explained, n = brute(rows)
    k = white.shape[1]
    assert len(got) == len(exact) * k
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, int(r.deviation)), []).append(r)
    assert sorted(map(str, by_id)) == sorted(map(str, set(exact)))
    signs = np.zeros(k)
    for at, (i, d) in enumerate(exact):
        mine = sorted(by_id[i, d], key=lambda r: r.component)
        z = np.array([r.whitened for r in mine[:: len(mine) // k]][:k])
        j = np.argmax(np.abs(white[at]))
        signs = np.where((signs == 0) & (np.abs(white[at]) > 0.1), np.sign(z * white[at]), signs)
        assert z[j] != 0
        assert np.abs(z - white[at] * np.where(signs == 0, np.sign(z * white[at]), signs)).max() < 1e-6
        assert all(r.n == n and abs(r.explained - explained[r.component - 1]) < 1e-9 and r.identity_error < 1e-6 for r in mine)


@pytest.mark.parametrize("tile", [None, 7, 64])
def test_real(spark, tile):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").repartition(3)
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in df.collect()]
    compare(whitening.whiten(df, tile=tile).collect(), rows)


def test_odd(spark):
    rng = np.random.default_rng(2)
    rows = [(i, list(map(float, rng.normal(size=5) * [9, 5, 3, 2, 1]))) for i in range(200)]
    rows += [(300, None), (301, [math.nan] * 5), (302, [1.0, None, 1.0, 1.0, 1.0]), (303, [math.inf] * 5), (304, [1.0, 2.0]), (305, []), (None, [3.0] * 5)]
    rows += [rows[3]] * 150  # a hot vector counts once
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as x", "2 as n", "3 as whitened", "4 as `a.b`")
    got = whitening.whiten(df).collect()
    assert {r.component for r in got} == {1, 2, 3, 4, 5} and sum(r.vec_id is None for r in got) == 5 and sum(r.vec_id == 3 for r in got) == 151 * 5
    compare([r for r in got], rows)


def test_no_variance(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert len(got) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in got)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(spark.createDataFrame([(1, [])], df.schema)).collect() == []


def test_large(spark):
    rows = [(i, [float(i * 10**9), float(i % 7)]) for i in range(-500, 500)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    exact, *_ = brute(rows)
    assert {(r.vec_id, int(r.deviation)) for r in got} == set(exact) and max(d for _, d in exact) > 1 << 63
    far = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whiten(far).collect()
