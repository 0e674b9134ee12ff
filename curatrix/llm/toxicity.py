"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its lower-cased words
(n = 3 to 5, with a space on both sides of a word).  Each is scaled by its
log-count ratio between toxic and clean training texts, and a logistic
regression is fitted on the scaled features (Wang and Manning, ACL 2012).
N-grams are hashed to 2**20 slots; the strongest ones by ratio and support are
kept, so that what most words share does not drown short insults in long texts.

The model is fitted on a bounded sample of labelled rows (``rows`` and
``text_bytes`` of ``fit``) and is two arrays of a few MB; scoring is one pass
over whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm import kernels as K
from curatrix.llm import labelled, workers
from curatrix.session import ship_package

SIZES = (3, 4, 5)
BITS = 20
_C = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


class Model(NamedTuple):
    """Weights by n-gram slot (0: unused), and the intercept."""

    weight: np.ndarray
    bias: float


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, all that isn't a letter or digit as a space, one at each end."""
    p = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    other = (p < 128) & ~(((p >= 97) & (p <= 122)) | ((p >= 48) & (p <= 57)))
    return np.where(other, np.uint32(32), p)


def slots(text: str) -> list[np.ndarray]:
    """Slots of the n-grams at all places, for each n; n-grams spanning a space inside are left out."""
    p = _points(text)
    space = p == 32
    gaps = np.concatenate(([0], np.cumsum(space)))
    out = []
    for n in SIZES:
        m = len(p) - n + 1
        if m <= 0:
            out.append(np.zeros(0, np.uint32))
            continue
        h = np.full(m, np.uint32(n * 0x01000193 & 0xFFFFFFFF))
        for k in range(n):
            h += p[k : k + m] * _C[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        inside = gaps[n - 1 : n - 1 + m] - gaps[1 : 1 + m]
        out.append((h >> np.uint32(32 - BITS))[inside == 0])
    return out


def fit(texts: list[str], y: np.ndarray, *, keep: int = 3_000, support: int = 5, alpha: float = 1.0, l2: float = 1e-3, rounds: int = 300) -> Model:
    """Fit on texts and 0/1 labels; with one class only, every score is that class's smoothed share."""
    y = np.asarray(y, np.float64)
    size = 1 << BITS
    pos, neg = np.zeros(size), np.zeros(size)
    sets = []
    for text, label in zip(texts, y, strict=True):
        s = np.unique(np.concatenate(slots(text)))
        sets.append(s)
        (pos if label else neg)[s] += 1
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    ratio = np.log((pos + alpha) / (n1 + 2 * alpha)) - np.log((neg + alpha) / (n0 + 2 * alpha))
    prior = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    weight = np.zeros(size, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(weight, prior)
    strength = np.where(pos + neg >= support, np.abs(pos / n1 - neg / n0) * np.abs(ratio), 0)
    chosen = np.argsort(-strength, kind="stable")[:keep]
    chosen = chosen[strength[chosen] > 0]
    column = np.full(size, -1, np.int64)
    column[chosen] = np.arange(len(chosen))
    cols = [c[c >= 0] for c in (column[s] for s in sets)]
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate(cols) if cols else np.zeros(0, np.int64)
    r = ratio[chosen]
    w, b = np.zeros(len(chosen)), prior
    vw, vb, mw, mb = np.zeros(len(chosen)), 0.0, np.zeros(len(chosen)), 0.0
    cost = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, (w * r)[col], len(y))
        g = cost * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        gw = np.bincount(col, g[row], len(w)) * r + l2 * w
        gb = g.sum()
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        w -= 0.03 * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-9)
        b -= 0.03 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    weight[chosen] = w * r
    return Model(weight, float(b))


def score(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probabilities that texts are toxic; null texts count as empty."""
    used = model.weight != 0
    z = np.full(len(texts), model.bias)
    for i, text in enumerate(texts):
        hit = [s[used[s]] for s in slots(text or "")]
        z[i] += model.weight[np.unique(np.concatenate(hit))].sum(dtype=np.float64)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _nothing() -> None:
    """Tasks keep no tables."""


def _apply(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        model = Model(weight, bias)
        for batch in batches:
            parts = [score(model, texts) for _, texts in K.pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = 4000, text_bytes: int = 16 << 10) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``, learned from ``labels(doc_id, toxic)``.

    All rows of ``labels`` may be learned from; the fit takes ``rows`` texts of
    at most ``text_bytes`` bytes.  Without labels every score is 0.5, with labels
    of one class all are that class's smoothed share.  Null texts are scored as
    empty ones; equal texts have equal scores, whatever their rows; repeated rows,
    and rows without an id, get a score each; an empty table gives no rows.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship_package(spark)
    data = labelled.sample(docs, labels, "toxic", rows=rows, text_bytes=text_bytes)
    model = fit(data.text.tolist(), data.y.to_numpy())
    shared = spark.sparkContext.broadcast(tuple(model))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(workers.task("toxicity", _apply(shared), _nothing), "doc_id long, score double")
