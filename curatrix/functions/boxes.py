"""Relative bounding boxes ``[x, y, w, h]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _side(box: Column, k: int) -> Column:
    return F.get(box, k)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; boxes without area overlap nothing."""
    w = F.least(_side(a, 0) + _side(a, 2), _side(b, 0) + _side(b, 2)) - F.greatest(_side(a, 0), _side(b, 0))
    h = F.least(_side(a, 1) + _side(a, 3), _side(b, 1) + _side(b, 3)) - F.greatest(_side(a, 1), _side(b, 1))
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = _side(a, 2) * _side(a, 3) + _side(b, 2) * _side(b, 3) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def square(box: Column) -> Column:
    """The smallest square of the same centre that holds the box."""
    side = F.greatest(_side(box, 2), _side(box, 3))
    return F.array(_side(box, 0) + (_side(box, 2) - side) / 2, _side(box, 1) + (_side(box, 3) - side) / 2, side, side)


def expand(box: Column, alpha: float) -> Column:
    """Both sides scaled by ``1 + alpha`` about the centre."""
    if alpha < -1:
        raise ValueError("alpha must be -1 or more")
    w, h = _side(box, 2), _side(box, 3)
    return F.array(_side(box, 0) - w * alpha / 2, _side(box, 1) - h * alpha / 2, w * (1 + alpha), h * (1 + alpha))
