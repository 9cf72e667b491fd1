"""Whitening against numpy's dense eigensolver."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from rolecall.llm import queries
from rolecall.llm.whitening import jacobi_davidson, whiten


def _wanted(vectors, components=16):
    """x of each row, the fit's n, mean, values and vectors."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = (n * distinct - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    return x, n, sums, values, values[order], axes[:, order]


def _same_but_sign(got, want, atol):
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < atol


def test_query_equals_a_dense_eigensolver(spark, medium):
    rows = queries.QUERIES["op12_whitening"](spark, medium).collect()
    table = spark.read.parquet(f"{medium}/embeddings.parquet").orderBy("vec_id").collect()
    x, n, sums, every, values, axes = _wanted([r.embedding for r in table])
    assert len(rows) == 16 * len(table)
    at = {r.vec_id: i for i, r in enumerate(table)}
    got = np.zeros((len(table), 16))
    for r in rows:
        i = at[r.vec_id]
        got[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert abs(r.explained * every.sum() / values[r.component - 1] - 1) < 1e-10
        assert r.identity_error < 1e-10
    _same_but_sign(got, (n * x - sums) / n @ axes / np.sqrt(values), 1e-9)


@pytest.mark.parametrize(
    "spectrum",
    [
        2.0 ** -np.arange(64),
        np.r_[np.ones(20), np.linspace(0.9, 0, 108)],
        np.r_[3.0, 2.0, 1.0, np.zeros(47)],
        1 / np.arange(1.0, 301),
        np.array([5.0, 4.0, 3.0]),
        np.array([2.0]),
    ],
)
def test_eigenpairs_have_double_precision(spectrum):
    size = len(spectrum)
    axes = np.linalg.qr(np.random.default_rng(5).normal(size=(size, size)))[0]
    matrix = axes * spectrum @ axes.T
    matrix = (matrix + matrix.T) / 2
    pairs = jacobi_davidson(lambda block: matrix @ block, size, 16, float(np.trace(matrix)))
    want = np.sort(spectrum)[::-1][:16]
    assert np.abs(pairs.values - want).max() < 1e-13 * spectrum.max()
    assert np.abs(matrix @ pairs.vectors - pairs.vectors * pairs.values).max() < 1e-13 * spectrum.max()
    assert np.abs(pairs.vectors.T @ pairs.vectors - np.eye(len(want))).max() < 1e-13


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(0, 10_000))
def test_largest_values_are_found_whatever_the_spectrum(size, seed):
    rng = np.random.default_rng(seed)
    half = rng.normal(size=(size, size)) * rng.choice([0, 1e-3, 1], size=size)
    matrix = half @ half.T
    pairs = jacobi_davidson(lambda block: matrix @ block, size, 5, float(np.trace(matrix)) or 1.0)
    want = np.linalg.eigvalsh(matrix)[::-1][:5]
    assert np.allclose(pairs.values, want, atol=1e-12 * max(1, want[0]))


def test_wide_rows_need_restarts(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(150, 90)) * np.linspace(3, 0.1, 90)).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = whiten(frame, components=4, widest=20).orderBy("vec_id").collect()
    x, n, sums, _, values, axes = _wanted(vectors, 4)
    got = np.array([[c.whitened for c in r.whitening.components] for r in rows])
    _same_but_sign(got, (n * x - sums) / n @ axes / np.sqrt(values), 1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 1.0, -2.0], 7), (2, [0.5, 1.0, -2.0], 8), (2, [1.5, 0.25, 3.0], 9),
        (None, [-4.0, 0.0, 1.0], 1), (3, None, 2), (4, [], 3), (5, [1.0, None, 2.0], 4),
        (6, [nan, 0.0, 0.0], 5), (7, [0.0, -inf, 0.0], 6), (8, [2.0, 2.0, 2.0], None),
    ]
    # Extra columns that have the names used inside.
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x long")
    frame = frame.selectExpr("*", "x AS row", "x AS v", "'w' AS whitening", "x AS n")
    found = whiten(frame).collect()
    kept = [r for r in rows if r[1] and not {None, nan, inf, -inf} & set(r[1])]
    kept = [r for r in kept if all(np.isfinite(r[1]))]
    assert sorted([(r.vec_id, r.row) for r in found], key=str) == sorted([(r[0], r[2]) for r in kept], key=str)
    assert found[0].asDict().keys() == {"vec_id", "embedding", "x", "row", "v", "whitening", "n"}
    x, n, sums, _, values, axes = _wanted([r[1] for r in kept])
    assert n == 4 and {r.whitening.n for r in found} == {4}
    assert all(len(r.whitening.components) == 3 for r in found)
    by_row = {r.row: r.whitening for r in found}
    got = np.array([[c.whitened for c in by_row[r[2]].components] for r in kept])
    _same_but_sign(got, (n * x - sums) / n @ axes / np.sqrt(values), 1e-9)
    assert [c.whitened for c in by_row[7].components] == [c.whitened for c in by_row[8].components]


def test_too_little_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    same = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)
    assert whiten(same).collect() == []
    line = spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.5, 1.0]), (3, [9.0, 1.0])], schema)
    found = whiten(line).collect()
    assert [len(r.whitening.components) for r in found] == [1, 1, 1]
    assert all(abs(r.whitening.components[0].explained - 1) < 1e-12 for r in found)


def test_unequal_lengths_and_huge_entries_raise(spark):
    schema = "vec_id long, embedding array<double>"
    with pytest.raises(ValueError):
        whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5])], schema))
    with pytest.raises(Exception, match="64 bits"):
        whiten(spark.createDataFrame([(1, [1e300]), (2, [0.5])], schema)).collect()
