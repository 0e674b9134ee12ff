"""Box matching: one shuffle, samples over several batches, odd boxes."""

import math
import random

import numpy as np
import pytest

from curatrix.operators import objects as O

GT = "sample_id string, id string, label string, bounding_box array<double>"
PRED = f"{GT}, confidence double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)

    def box():
        return rng.choice([None, [0.1, 0.1], [0.2, 0.0, 0.0, 0.5]]) if rng.random() < 0.1 else [rng.random() * 0.3, 0.0, 0.5, 0.5]

    sizes = {f"s{k}": rng.randrange(4) for k in range(30)} | {"hot": 60, None: 5}
    gt = [(s, f"g{i}", rng.choice("ab"), box()) for s, n in sizes.items() for i in range(n)]
    pred = [(s, f"p{i}", rng.choice("ab"), box(), rng.choice([0.5, 0.9, 0.97, None])) for s, n in sizes.items() for i in range(n)]
    return gt, pred, spark.createDataFrame(gt, GT), spark.createDataFrame(pred, PRED)


def iou(a, b):
    if not a or not b or len(a) < 4 or len(b) < 4:
        return 0.0
    w, h = (max(0.0, min(a[k] + a[k + 2], b[k] + b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return round(w * h / union, 9) if union > 0 else 0.0


def matches(gt, pred):
    out = {}
    for s in {r[0] for r in gt} - {None}:
        free = {r[1]: r[3] for r in gt if r[0] == s}
        for p in sorted((p for p in pred if p[0] == s), key=lambda p: (math.inf if p[4] is None else -p[4], p[1])):
            fits = sorted((-iou(b, p[3]), g) for g, b in free.items() if iou(b, p[3]) >= 0.5)
            if fits:
                out[s, fits[0][1]] = p[1], -fits[0][0]
                del free[fits[0][1]]
    return out


@pytest.mark.parametrize("rows", [65_536, 7])
def test_matches_by_brute_force(tables, rows, monkeypatch):
    gt, pred, g, p = tables
    monkeypatch.setattr(O, "ROWS", rows)
    want = matches(gt, pred)
    got = {(r.sample_id, r.gt_id): (r.pred_id, r.iou) for r in O.match_boxes(g, p).collect()}
    assert {k: (i, round(x, 8)) for k, (i, x) in got.items()} == {k: (i, round(x, 8)) for k, (i, x) in want.items()}
    found = O.object_mistakenness(g, p).collect()
    mine = [r for r in found if r.side == "gt"]
    assert sorted((str(r.sample_id), r.id) for r in mine) == sorted((str(r[0]), r[1]) for r in gt)
    assert {(r.sample_id, r.id) for r in mine if not r.possible_spurious} == set(want)
    taken = {(s, i) for (s, _), (i, _) in want.items()}
    lost = sorted((str(s), i) for s, i, _, _, c in pred if (s, i) not in taken and c and c > 0.95)
    assert sorted((str(r.sample_id), r.id) for r in found if r.possible_missing) == lost


def test_matching_shuffles_once(tables):
    _, _, g, p = tables
    for df in (O.match_boxes(g, p), O.object_mistakenness(g, p)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_hot_sample_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    side = np.repeat([0, 1], 40)
    box = np.stack([rng.random(80) * 0.4, np.zeros(80), np.full(80, 0.5), np.full(80, 0.5)], 1)
    whole = O._one_to_one(np.zeros(80, int), side, box, rng.random(80), 0.5)
    monkeypatch.setattr(O, "PAIRS", 90)
    rng = np.random.default_rng(1)
    rng.random(80)
    steps = O._one_to_one(np.zeros(80, int), side, box, rng.random(80), 0.5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, steps)) and len(whole[0]) > 10
