"""Whitening against a plain eigenvalue solver."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from samples import SF_DIR

from tablesmith.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, component int"


def plain(rows: list[tuple], most: int = 4) -> dict[tuple, list]:
    """The results by id and component, from the covariance itself."""
    kept = [(i, e) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    size = max((len(e) for _, e in kept), default=1) or 1
    ints = np.array([np.pad(np.floor(256 * np.array(e, np.float32).astype(float)), (0, size - len(e))) for _, e in kept]).astype(np.int64).reshape(-1, size)
    fit = np.unique(ints, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    most = min(most, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    out: dict = {}
    for (i, _), row in zip(kept, ints):
        white = (row - sums / n) @ vectors[:, :most] / np.sqrt(values[:most])
        for k in range(most):
            out.setdefault((i, k + 1), []).append((n, int(((n * row - sums) ** 2).sum()), white[k], values[k] / values.sum()))
    return out


def check(result: list, rows: list[tuple]) -> None:
    want = plain(rows)
    got: dict = {}
    for r in result:
        got.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
        assert 0.0 <= r.identity_error <= 1e-10
    assert got.keys() == want.keys()
    signs: dict = {}
    for key, values in want.items():
        mine, theirs = sorted(got[key], key=lambda v: (v[1], abs(v[2]))), sorted(values, key=lambda v: (v[1], abs(v[2])))
        assert len(mine) == len(theirs)
        for m, t in zip(mine, theirs):
            assert m[:2] == t[:2] and m[3] == pytest.approx(t[3], rel=1e-10)
            if abs(t[2]) > 1e-3:
                assert m[2] == pytest.approx(t[2] * signs.setdefault(key[1], np.sign(m[2] * t[2])), rel=1e-8, abs=1e-8)


def test_whitening(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF_DIR}/embeddings.parquet'").fetchall()
    check(queries.op11_whitening(spark, SF_DIR).collect(), rows)


def test_whitening_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] * 2 + [(None, [0.5, -0.25]), (50, []), (51, None), (52, [1.0, None, 2.0]), (53, [float("nan")] * 5), (54, [float("inf"), 0, 0, 0, 0]),
            (55, [-0.0] * 5), (56, [0.5, -0.25, 0.0, 0.0, 0.0]), (57, [-0.5, 0.25])]
    rows = [(i, None if e is None else [None if c is None else float(c) for c in e]) for i, e in rows]
    frame = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA).repartition(4)
    result = whitening.whitened(frame)
    assert result.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(result.collect(), rows)


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0], 1), (2, [0.5, 1.0], 1)], SCHEMA)
    assert whitening.whitened(one).collect() == []
    assert whitening.whitened(one.where("false")).collect() == []
    assert whitening.whitened(spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)).collect() == []
    # two vectors vary along one line only
    pair = [(1, [0.5, 1.0]), (2, [0.25, 2.0])]
    check(whitening.whitened(spark.createDataFrame([(i, e, 1) for i, e in pair], SCHEMA)).collect(), pair)


def test_large_entries(spark):
    far = spark.createDataFrame([(1, [3e30], 1)], SCHEMA)
    with pytest.raises(Exception, match="no long"):
        whitening.whitened(far).collect()
    wide = spark.createDataFrame([(1, [1e13], 1), (2, [-1e13], 1), (3, [1.0], 1)], SCHEMA)
    assert {r.vec_id: r.deviation for r in whitening.whitened(wide).collect()}[1] is None


def matrices() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(1)
    turned, _ = np.linalg.qr(rng.standard_normal((48, 48)))
    spectrum = lambda values: (turned * np.array([*values, *[1.0] * (48 - len(values))])) @ turned.T
    return {
        "plain": rng.standard_normal((300, 48)), "few rows": rng.standard_normal((20, 48)), "all equal": np.eye(48) * 3, "zero": np.zeros((5, 8)),
        "one line": np.ones((5, 8)), "one column": np.arange(5.0)[:, None], "graded": rng.standard_normal((300, 48)) * np.logspace(0, -12, 48),
        "five equal": spectrum([3] * 5), "nearly equal": spectrum([3, 3 * (1 - 1e-9), 3 * (1 - 1e-12), 3, 2]), "tiny": rng.standard_normal((60, 6)) * 1e-140,
        "huge": rng.standard_normal((60, 6)) * 1e140,
    }


@pytest.mark.parametrize("name", matrices())
def test_solver(name):
    rows = matrices()[name]
    square = whitening.triangle(rows, rows.shape[1])
    a, b, right = whitening.bidiagonal(square)
    exact = np.linalg.svd(square, compute_uv=False)
    largest = exact[0] or 1.0
    assert np.abs(right.T @ right - np.eye(len(a))).max() < 1e-13
    assert np.abs(np.sqrt(whitening.dqds(a, b)) - exact).max() <= 1e-13 * largest
    values, vectors = whitening.directions(square)
    assert len(values) == min(4, int((exact > 1e-12 * largest).sum()))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-11
    scaled = square / largest
    for value, vector in zip(values, vectors.T):
        assert np.linalg.norm(scaled.T @ (scaled @ vector) - value / largest / largest * vector) < 1e-12


def test_small_singular_values_keep_their_digits():
    # the squares of singular values of a bidiagonal by exact arithmetic: their product is that of the diagonal
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([1.0, 1e-2, 1e-7])
    found = whitening.dqds(a, b)
    assert np.prod(found) == pytest.approx(np.prod(a) ** 2, rel=1e-13) and (found > 0).all()
