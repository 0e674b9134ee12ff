"""Text quality: random-indexing word vectors, pooled, and a small calibrated network.

Every token (a run of letters, of digits or of other signs) has a sparse ternary
index vector drawn from its hash.  A token's context vector is the sum of the
index vectors within ``WINDOW`` places of its occurrences, gathered over the
training texts and scaled to unit length: words that keep the same company point
the same way (random indexing, Kanerva et al. 2000).  A text is the mean of its
tokens' context vectors and the mean of their index vectors, whose length grows
when few tokens repeat, with the share of tokens whose index vector is that of
the token before, the log of its length and the shares of token shapes.  A network with one hidden layer turns this into a logit; a temperature
fitted on texts that the network did not see turns the logit into a probability.

The whole model, vectors included, is fitted on a bounded sample of labelled
rows (``rows`` and ``text_bytes``); it is a few MB whatever the corpus, and
scoring is one pass over whole texts.
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

DIM, SIGNS, WINDOW, SLOTS = 48, 4, 2, 1 << 16
HIDDEN, STEP = 24, 16_384


class Model(NamedTuple):
    """Context vectors by slot, feature centre and scale, two layers, temperature."""

    context: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def _index_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense index vectors of all slots, and their places and signs."""
    h = K.mix64(np.arange(1, SLOTS * SIGNS + 1, dtype=np.uint64)).reshape(SLOTS, SIGNS)
    place = (h % np.uint64(DIM)).astype(np.int64)
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).astype(np.float32)
    dense = np.zeros((SLOTS, DIM), np.float32)
    np.add.at(dense, (np.arange(SLOTS)[:, None], place), sign)
    return dense, place, sign


_tables: list[np.ndarray] = []


def _release() -> None:
    _tables.clear()
    K.release()


def index_table() -> np.ndarray:
    if not _tables:
        _tables.extend(_index_vectors())
    return _tables[0]


def _tokens(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and shapes of a block's tokens, and where each text's begin."""
    w = K.words(block, K.SHAPES)
    ids = (K.word_hashes(block, w) & np.uint64(SLOTS - 1)).astype(np.int64)
    return ids, K.SHAPES[block.data[w.start]], w.bounds


def context_vectors(texts: list[str]) -> np.ndarray:
    """Unit context vectors by slot; slots that no text uses stay zero."""
    index_table()
    _, place, sign = _tables
    total = np.zeros(SLOTS * DIM)
    for block in K.blocks(pa.array(texts, pa.string())):
        ids, _, bounds = _tokens(block)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for d in range(1, WINDOW + 1):
            if len(ids) <= d:
                continue
            same = owner[d:] == owner[:-d]
            a, b = ids[:-d][same], ids[d:][same]
            for x, y in ((a, b), (b, a)):
                for k in range(SIGNS):
                    total += np.bincount(x * DIM + place[y, k], sign[y, k], SLOTS * DIM)
    table = total.reshape(SLOTS, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.where(norm > 0, norm, 1)).astype(np.float32)


def features(context: np.ndarray, column: pa.Array) -> np.ndarray:
    """One row of pooled features for each text; empty texts give zeros."""
    index = index_table()
    out = np.zeros((len(column), 2 * DIM + 8))
    for block in K.blocks(column):
        ids, shape, bounds = _tokens(block)
        rows, n = len(bounds) - 1, np.diff(bounds)
        pooled = np.zeros((rows, 2 * DIM), np.float64)
        full = np.flatnonzero(n)
        at = 0
        while at < len(full):  # texts in steps of bounded size, long texts in several
            to = max(at + 1, int(np.searchsorted(bounds[full + 1], bounds[full[at]] + STEP, "right")))
            lo, hi = bounds[full[at]], bounds[full[to - 1] + 1]
            for s in range(lo, hi, STEP):
                e = min(hi, s + STEP)
                inside = full[at:to][(bounds[full[at:to]] < e) & (bounds[full[at:to] + 1] > s)]
                cut = np.maximum(bounds[inside], s) - s
                part = ids[s:e]
                pooled[inside, :DIM] += np.add.reduceat(context[part], cut)
                pooled[inside, DIM:] += np.add.reduceat(index[part], cut)
            at = to
        size = np.maximum(n, 1)[:, None]
        here = out[block.first : block.first + rows]
        here[:, : 2 * DIM] = pooled / size
        shares = [np.add.reduceat(np.append(shape == k, False), np.minimum(bounds[:-1], len(shape)), dtype=np.int64) * (n > 0) for k in (1, 2, 3)]
        known = np.append(np.abs(context[:, 0]) + np.abs(context[:, 1]) > 0, False)[ids] if len(ids) else np.zeros(0, bool)
        here[:, 2 * DIM] = np.log1p(n)
        for k, share in enumerate(shares):
            here[:, 2 * DIM + 1 + k] = share / size[:, 0]
        here[:, 2 * DIM + 4] = np.add.reduceat(np.append(known, False), np.minimum(bounds[:-1], len(known)), dtype=np.int64) * (n > 0) / size[:, 0]
        again = np.zeros(len(ids) + 1, bool)
        if len(ids):
            np.equal(ids[1:], ids[:-1], out=again[1:-1])
            again[bounds[:-1]] = False
        here[:, 2 * DIM + 7] = np.add.reduceat(again, np.minimum(bounds[:-1], len(ids)), dtype=np.int64) * (n > 0) / size[:, 0]
        here[:, 2 * DIM + 5] = np.log((here[:, DIM : 2 * DIM] ** 2).sum(1) + 1e-3)
        here[:, 2 * DIM + 6] = np.log((here[:, :DIM] ** 2).sum(1) + 1e-3)
    return out


def _logits(x: np.ndarray, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float) -> np.ndarray:
    return np.tanh(x @ w1 + b1) @ w2 + b2


def _train(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        z = h @ p[2] + p[3][0]
        g = cost * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        dh = np.outer(g, p[2]) * (1 - h * h)
        grads = [x.T @ dh + 1e-3 * p[0], dh.sum(0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return p


def fit(texts: list[str], y: np.ndarray, *, share: float | None = None, rounds: int = 400, seed: int = 11) -> Model:
    """Fit on texts and 0/1 labels.

    ``share`` is label 1's share among all labelled rows; the sample is weighted
    to it.  Without both classes the network is constant at the smoothed share.
    """
    y = np.asarray(y, np.float64)
    context = context_vectors(texts)
    width = 2 * DIM + 8
    if len(y) < 10 or y.min() == y.max():
        prior = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
        return Model(context, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), prior, 1.0)
    x = features(context, pa.array(texts, pa.string()))
    share = y.mean() if share is None else share
    cost = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    centre, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - centre) / scale
    held = np.arange(len(y)) % 5 == 0
    p = _train(x[~held], y[~held], cost[~held], rounds, seed)
    z = _logits(x[held], p[0], p[1], p[2], p[3][0])
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [float((cost[held] * np.logaddexp(0, np.where(y[held] == 1, -z, z) / t)).mean()) for t in grid]
    return Model(context, centre, scale, p[0], p[1], p[2], float(p[3][0]), float(grid[int(np.argmin(loss))]))


def score(model: Model, column: pa.Array) -> np.ndarray:
    """Probabilities of label 1; null texts count as empty."""
    x = (features(model.context, column) - model.centre) / model.scale
    z = _logits(x, model.w1, model.b1, model.w2, model.b2) / model.temperature
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fitted(docs: DataFrame, labels: DataFrame, *, rows: int = 6000, text_bytes: int = 16 << 10) -> Model:
    """Fit on ``labels(doc_id, quality)``, all of whose rows may be learned from."""
    ship_package(docs.sparkSession)
    data = labelled.sample(docs, labels, "quality", rows=rows, text_bytes=text_bytes)
    both = labels.where(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    return fit(data.text.tolist(), data.y.to_numpy(), share=both)


def _apply(shared, text_at: int, least: float | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            s = score(model, batch.column(text_at))
            if least is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])
            else:
                yield batch.filter(pa.array(s >= least))

    return workers.task("quality", run, _release)


def score_quality(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``, learned from ``labels(doc_id, quality)``.

    All rows of ``labels`` may be learned from, up to the bounds of ``fitted``.
    Without labels every score is 0.5, with labels of one class all are that
    class's smoothed share.  Null texts are scored as empty ones; equal texts have
    equal scores, whatever their rows; repeated rows, and rows without an id, get
    a score each; an empty table gives no rows.  Other columns are ignored,
    whatever their names.
    """
    model = fitted(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_apply(shared, 1, None), "doc_id long, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, *, least: float = 0.5, **bounds: int) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, with all their columns.

    Scores are those of ``score_quality``; a score equal to ``least`` stays.  Null
    and empty texts are judged as empty ones, repeated rows alike; an empty table
    gives no rows.
    """
    model = fitted(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    return docs.mapInArrow(_apply(shared, docs.columns.index("text"), least), docs.schema)
