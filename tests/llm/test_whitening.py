"""The incremental eigendecomposition against one eigenproblem of the whole covariance."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from headcount.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x string, part string"


def scatter(rows):
    apart = rows - rows.mean(axis=0)
    return apart.T @ apart


def rebuilt(own):
    return own.basis @ np.diag(own.values) @ own.basis.T


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 30), st.integers(0, 10_000), st.booleans())
def test_updates_and_joins_equal_the_whole(width, count, seed, coarse):
    draw = np.random.default_rng(seed)
    rows = draw.standard_normal((count, width)) * draw.choice([1e-3, 1.0, 500.0], width)
    if coarse:  # repeated rows, equal and missing directions
        rows = np.round(rows / 400) * 400
    size = max(np.abs(scatter(rows)).max(), 1e-300)
    whole, left, right = (whitening.Spectrum(width) for _ in range(3))
    for i, row in enumerate(rows):
        whole.add(row)
        (left if i % 3 else right).add(row)
    if right.count and left.count:
        left.join(right.count, right.mean, right.values, right.basis)
        assert np.abs(rebuilt(left) - scatter(rows)).max() < 1e-11 * size and left.count == count
    assert np.abs(rebuilt(whole) - scatter(rows)).max() < 1e-11 * size
    assert np.abs(whole.basis.T @ whole.basis - np.eye(whole.basis.shape[1])).max(initial=0) < 1e-12


def test_secular_roots_interlace_at_close_values():
    values = np.array([1.0, 1.0 + 1e-12, 2.0, 1e6])
    change = np.array([1e-3, 1.0, 1e-5, 10.0])
    found, turn = whitening.secular(values, change)
    whole = np.diag(values) + np.outer(change, change)
    assert (found[:-1] >= values[:-1]).all() and (found[:-1] <= values[1:]).all()
    assert np.abs(turn.T @ turn - np.eye(4)).max() < 1e-13
    assert np.abs(turn @ np.diag(found) @ turn.T - whole).max() < 1e-9


def plain(rows, k=8):
    """One eigenproblem of the exact integers."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in r] for r in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    apart = np.array([[n * v - s for v, s in zip(r, sums, strict=True)] for r in x], dtype=float) / n
    values, vectors = np.linalg.eigh(apart.T @ apart / n)
    order = np.argsort(-values)[:k]
    order = [i for i in order if values[i] > 1e-12 * values.max()]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    return n, deviation, apart @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("count,width", [(700, 12), (60, 64), (5, 3), (3, 4)])
def test_against_one_eigenproblem(spark, count, width):
    draw = np.random.default_rng(count)
    rows = (draw.standard_normal((count, width)) * np.linspace(1, 0.05, width)).astype(np.float32)
    rows[count // 2] = rows[0]
    data = [(None if i == 1 else i, r.tolist(), 1, "x", "p") for i, r in enumerate(rows)]
    odd = [None, [], [None] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [1e30] * width, [1.0]]
    data += [(10_000 + i, v, 1, "x", "p") for i, v in enumerate(odd)]
    got = whitening.whiten(spark.createDataFrame(data, SCHEMA).repartition(11)).collect()
    n, deviation, white, explained = plain(rows)
    assert len(got) == count * white.shape[1] and {r.n for r in got} == ({n} if white.size else set())
    if not white.size:
        return
    at = {(r.vec_id, r.component): r for r in got}
    for k in range(white.shape[1]):
        own = np.array([at[None if i == 1 else i, k + 1].whitened for i in range(count)])
        sign = np.sign(own @ white[:, k])
        assert np.abs(own * sign - white[:, k]).max() < 1e-7
        assert abs(at[0, k + 1].explained - explained[k]) < 1e-10
    assert all(at[i, 1].deviation == deviation[i] for i in range(count) if i != 1)
    assert got[0].identity_error < 1e-9 and len({r.identity_error for r in got}) == 1


def test_without_variance(spark):
    one = [(1, [0.5, 0.25], 0, "", ""), (2, [0.5, 0.25], 0, "", ""), (3, None, 0, "", "")]
    for data in ([], one, one[:1], one[2:]):
        got = whitening.whiten(spark.createDataFrame(data, SCHEMA))
        assert got.columns[:2] == ["vec_id", "component"] and got.collect() == []


def test_a_poor_basis_is_refined(spark):
    draw = np.random.default_rng(3)
    x = np.round(draw.standard_normal((400, 10)) * np.linspace(900, 30, 10)).astype(np.int64)
    vectors = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    basis, _ = np.linalg.qr(draw.standard_normal((10, 5)))
    values, found, trace = whitening.refine(vectors, 400, x.sum(axis=0), basis, 2)
    whole = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.abs(values[:2] / whole[:2] - 1).max() < 1e-6 and abs(trace / whole.sum() - 1) < 1e-12
