"""Whitening against numpy's eigenvectors, and the qd solver against its singular values."""

import math

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from minekit.llm import qd, whitening
from minekit.llm.queries import QUERIES


def brute(rows):
    """Per row id and component the expected numbers, from plain whole-number sums and numpy's eigh."""
    rows = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in whole}), float)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for k, x in whole:
        far = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        out[k] = (n, far, [(np.array(x) - sums / n) @ vectors[:, i] / math.sqrt(values[i]) for i in range(4)], values[:4] / np.trace(cov))
    return out


def test_query_like_numpy(spark):
    want = brute([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()])
    rows = QUERIES["op12_whitening"](spark, SMALL).collect()
    assert len(rows) == 4 * len(want) and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    signs = {}
    for r in sorted(rows, key=lambda r: -abs(r["whitened"])):
        n, far, white, share = want[r["vec_id"]]
        i = r["component"] - 1
        sign = signs.setdefault(i, math.copysign(1, r["whitened"] * white[i]))
        assert (r["n"], r["deviation"]) == (n, far) and r["explained"] == pytest.approx(share[i], rel=1e-10)
        assert r["whitened"] == pytest.approx(sign * white[i], abs=1e-7)


def test_factors_meet_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FACTOR_BYTES", 1)  # two factors to a group
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 100)
    rng = np.random.default_rng(5)
    data = (rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6))).tolist()
    data += [data[0]] * 200  # a hot vector counts once
    df = spark.createDataFrame(list(enumerate(data)), "vec_id long, embedding array<double>").repartition(13)
    model = whitening.fit(df)
    want = brute(list(enumerate(data)))
    assert model.n == 300 == want[0][0] and model.identity_error < 1e-10
    got = {r["vec_id"]: r for r in whitening.whiten(df, model).collect()}
    assert len(got) == 500 and got[0]["whitened"] == got[499]["whitened"]
    for k, (_, far, white, _) in want.items():
        assert got[k]["deviation"] == far and np.allclose(np.abs(got[k]["whitened"]), np.abs(white), atol=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [3.0]), (None, [0.5, -0.5]), (8, [1e300, 0.0]), (9, [-0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("x", "whitened", "n", "part")})
    got = whitening.whiten(df, whitening.fit(df)).collect()
    assert sorted((r["vec_id"] for r in got), key=str) == [1, 1, 8, 9, None] and {r["n"] for r in got} == {"own"}
    assert [r["deviation"] for r in got if r["vec_id"] == 8] == [None]  # beyond a long
    same = df.where("vec_id = 1")
    model = whitening.fit(same)
    got = whitening.whiten(same, model).collect()
    assert model.n == 1 and model.identity_error is None and [(r["deviation"], r["whitened"]) for r in got] == [(0, [None, None])] * 2
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)], "vec_id long, embedding array<double>")
    model = whitening.fit(line)
    assert [v > 0 for v in model.values] == [True, False, False] and model.explained[0] == pytest.approx(1) and model.identity_error < 1e-12
    for none in (df.limit(0), df.where("vec_id in (2, 6)")):
        assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0


def matrices():
    rng = np.random.default_rng(0)
    turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    for n in (1, 2, 3, 5, 16, 33, 64):
        yield from (np.triu(rng.standard_normal((n, n))), np.eye(n), np.ones((n, n)), turn(n) * 3, np.diag(np.arange(n) + 1.0))
        yield np.linalg.qr(rng.standard_normal((200, n)) * np.logspace(-6, 0, n), mode="r")
        yield np.linalg.qr(rng.standard_normal((200, -(-n // 2))) @ rng.standard_normal((-(-n // 2), n)), mode="r")
        yield turn(n) @ np.diag(np.repeat(np.arange(n // 2 + 1) + 1.0, 2)[:n]) @ turn(n)
        yield turn(n) @ np.diag(1 + 1e-7 * np.arange(n)) @ turn(n)
        yield np.diag(np.abs(np.arange(n) - n // 2) + 1.0) + np.diag(np.ones(n - 1), 1)


def test_solver_on_many_matrices():
    for a in matrices():
        values, vectors = qd.right_singular(a)
        truth = np.linalg.svd(a, compute_uv=False)
        assert np.abs(np.sqrt(values) - truth).max() <= 1e-13 * truth[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() <= 1e-10
        assert np.abs(a.T @ a @ vectors - vectors * values).max() <= 1e-12 * truth[0] ** 2


def test_small_values_keep_their_digits():
    """dqds gives every singular value of a bidiagonal matrix to relative accuracy, not only the large ones."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    d, u = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([0.5, 2e-4, 3e-7])
    low = qd.dqds(d, u)[-1]
    # the product of all values is known exactly, and the three larger ones come from the reversed problem
    product = Decimal(1)
    for v in d:
        product *= Decimal(float(v)) ** 2
    others = Decimal(1)
    for v in qd.dqds(d, u)[:-1]:
        others *= Decimal(float(v))
    assert float(product / others) == pytest.approx(low, rel=1e-13)
