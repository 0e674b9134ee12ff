"""Steps whose work or memory must not grow with all pairs."""

import numpy as np
import pytest

from curatrix.operators import duplicates as D
from curatrix.operators import neighbors as N
from curatrix.operators.index import build_index


def greedy(d, t):
    kept = []
    for i in range(len(d)):
        if all(d[i, j] > t for j in kept):
            kept.append(i)
    return kept


def bisected(d, count, start=0.5, width=1e-6):
    lo, hi, best = 0.0, start, None
    while len(kept := greedy(d, hi)) > count:
        lo, hi, best = hi, 2 * hi, (kept, hi)
    if len(kept) == count:
        return kept, hi
    while hi - lo > width:
        mid = (lo + hi) / 2
        kept = greedy(d, mid)
        if len(kept) >= count:
            best, lo = (kept, mid), mid
        else:
            hi = mid
        if len(kept) == count:
            break
    return best


@pytest.fixture(scope="module")
def unlike(spark):
    """120 vectors, of which some are copies of others."""
    x = np.random.default_rng(5).normal(size=(120, 6))
    x[100:110], x[110:] = x[7], x[:10]
    index = build_index(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, v array<double>"), "id", "v")
    c = x - x.mean(0)
    return index, N.pairwise(c, c, "cosine")


@pytest.mark.parametrize("count, few", [(4, 1_000_000), (30, 1_000_000), (60, 1_000_000), (60, 0)])
def test_find_unique_writes_no_dense_pairs(unlike, count, few, monkeypatch):
    index, d = unlike
    asked = []
    monkeypatch.setattr(D, "FEW_EDGES", few)
    monkeypatch.setattr(D, "radius_neighbors", lambda i, t, **o: asked.append(t) or N.radius_neighbors(i, t, **o))
    kept, thresh = D.find_unique(index, count)
    want, t = bisected(d, count)
    assert (sorted(r.id for r in kept.collect()), thresh) == (want, t)
    assert all(len(greedy(d, t)) * D.SPARSE >= 120 for t in asked) and len(asked) <= 1


def test_rounds_decide_as_one(unlike, monkeypatch):
    index, d = unlike
    monkeypatch.setattr(D, "ROUND_BYTES", 0)
    monkeypatch.setattr(D, "BUCKET", 16)
    assert sorted(r.id for r in D.Ordered(index).greedy_pass(0.3)[0].collect()) == greedy(d, 0.3)
    assert D.Ordered(index).greedy_pass(0.3, 5)[0] is None
    assert sorted(r.id for r in D.find_unique(index, 30)[0].collect()) == bisected(d, 30)[0]


def test_duplicates_need_no_pairs(unlike, monkeypatch):
    index, d = unlike
    edges = N.radius_neighbors(index, 0.4)
    want = sorted(map(str, D.find_duplicates(index, 0.4, edges).collect()))
    monkeypatch.setattr(D, "radius_neighbors", None)
    assert sorted(map(str, D.find_duplicates(index, 0.4).collect())) == want
