"""Block products against all distances."""

import numpy as np
import pytest

from curatrix.operators import neighbors as N


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dotproduct", "l1"])
def test_products_leave_few_pairs_to_decide(metric, monkeypatch):
    """Neighbours and pairs equal those of all distances, which are not computed where products rank pairs."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 32))
    x[10], x[30], x[40:80] = x[20], 0, x[40]
    ids = rng.permutation(300)
    d = N.pairwise(x, x, metric)
    np.fill_diagonal(d, np.inf)
    thresh = np.quantile(d[np.isfinite(d)], 0.03)
    calls, real = [], N.pairwise
    monkeypatch.setattr(N, "BLOCK", 64)
    monkeypatch.setattr(N, "pairwise", lambda a, b, m: calls.append(1) or real(a, b, m))
    got = [(int(r), int(c)) for rows, cols, _ in N.pairs_within(x, x, thresh, metric) for r, c in zip(rows, cols) if r != c]
    assert sorted(got) == [tuple(map(int, p)) for p in np.argwhere(d <= thresh)]
    row, col, dist = N.nearest_of(x, x, ids, ids, 3, metric)
    want = [(i, j) for i in range(300) for j in sorted((j for j in range(300) if np.isfinite(d[i, j])), key=lambda j: (d[i, j], ids[j]))[:3]]
    assert list(zip(row.tolist(), col.tolist())) == want and np.array_equal(dist, [d[p] for p in want])
    assert len(calls) == 50 if metric == "l1" else len(calls) <= 10


def test_far_and_huge_vectors_are_exact():
    x = np.random.default_rng(3).normal(size=(200, 8))
    for y in (x + 1e6, x * 1e20, x * 1e-12):
        d = N.pairwise(y, y, "euclidean")
        t = np.quantile(d, 0.1)
        got = sum(len(r) for r, _, _ in N.pairs_within(y, y, t, "euclidean"))
        assert got == (d <= t).sum()
