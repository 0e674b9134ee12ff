"""Low-dimensional projections that can be extended, and what plots are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions import vectors as V
from curatrix.operators.index import SimilarityIndex
from curatrix.operators.neighbors import pairwise
from curatrix.session import ship_package

#: Methods by name: ``(index, num_dims, options) -> Projection``; ``register_method`` adds to them.
METHODS: dict[str, Callable[..., Projection]] = {}


@dataclass(frozen=True)
class Projection:
    """``points(id, point)``, and what places further rows.

    PCA has the mean and components, a layout its fitted vectors (centred) and
    their points, of as many rows as it was fitted on.
    """

    points: DataFrame
    method: str
    mean: list[float] | None = None
    components: list[list[float]] | None = None
    trained_on: int = 0
    anchors: tuple[np.ndarray, np.ndarray] | None = None
    trained: DataFrame | None = None
    whole: DataFrame | None = None

    def restrict(self, ids: DataFrame) -> Projection:
        """With the points of ``ids(id)`` only, as they are now."""
        return replace(self, points=self.points.join(ids.select("id").distinct(), "id", "left_semi"), whole=self.points if self.whole is None else self.whole)

    def clear(self) -> Projection:
        """With all points again."""
        return self if self.whole is None else replace(self, points=self.whole, whole=None)

    def training(self, rows: DataFrame) -> DataFrame:
        """The rows of ``rows(id, embedding)`` that the projection was fitted on, of which none may be missing."""
        if self.trained is None:
            raise ValueError(f"{self.method} projections keep no training rows")
        have = rows.where("embedding is not null")
        lost = self.trained.join(have.select("id"), "id", "left_anti").count()
        if lost:
            raise ValueError(f"{lost} rows that the projection was fitted on have no vector any more")
        return have.join(self.trained, "id", "left_semi")

    @property
    def supports_updates(self) -> bool:
        return self.components is not None or (self.method == "umap" and self.anchors is not None)

    def new_ids(self, rows: DataFrame) -> DataFrame:
        """Ids of ``rows(id)`` without a point."""
        return rows.select("id").distinct().join(self.points.select("id"), "id", "left_anti")

    def needs_update(self, rows: DataFrame) -> bool:
        return not self.new_ids(rows).isEmpty()

    def outgrown(self, share: float = 0.2) -> bool:
        """Whether rows added since the fit exceed ``share`` of those it saw."""
        return self.points.count() - self.trained_on > share * self.trained_on

    def project(self, rows: DataFrame) -> DataFrame:
        if self.components is None:
            return _placed(rows, self.mean, *self.anchors)
        centred = V.minus(V.vector("embedding"), V.literal(self.mean))
        return rows.select("id", F.array(*[V.dot(centred, V.literal(c)) for c in self.components]).alias("point"))

    def add(self, rows: DataFrame) -> Projection:
        """With points for the rows of ``rows(id, embedding)`` that have none; others keep theirs."""
        if not self.supports_updates:
            raise ValueError(f"{self.method} projections can't be extended")
        width = rows.agg(F.max(F.size("embedding"))).first()[0]
        if width is not None and width > 0 and width != len(self.mean):
            raise ValueError(f"vectors have {width} dimensions, the projection was fitted on {len(self.mean)}")
        fresh = rows.where("embedding is not null").dropDuplicates(["id"]).join(self.points.select("id"), "id", "left_anti")
        return replace(self, points=self.points.unionByName(self.project(fresh)))


def pca(index: SimilarityIndex, num_dims: int = 2) -> Projection:
    """Projection of the centred vectors on their first components; each component's largest entry is positive."""
    mean = V.mean_vector(index.rows)
    if mean is None:
        return _empty(index, "pca")
    rows = index.rows.select(array_to_vector(V.minus(F.col("embedding"), V.literal(mean))).alias("x"))
    model = PCA(k=num_dims, inputCol="x", outputCol="y").fit(rows)
    parts = model.pc.toArray().T
    parts = parts * np.sign(parts[np.arange(num_dims), np.abs(parts).argmax(1)])[:, None]
    out = Projection(index.rows.select("id"), "pca", mean, parts.tolist(), index.size(), trained=index.rows.select("id"))
    return replace(out, points=out.project(index.rows))


def _empty(index: SimilarityIndex, method: str) -> Projection:
    kind = index.base.schema["id"].dataType.simpleString()
    return Projection(index.base.sparkSession.createDataFrame([], f"id {kind}, point array<double>"), method)


def manual(points: DataFrame) -> Projection:
    """Points given by the caller: ``points(id, point)``."""
    return Projection(points.select("id", V.vector("point").alias("point")), "manual", trained_on=points.count())


def _affinities(d2: np.ndarray, perplexity: float) -> np.ndarray:
    n = len(d2)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            w = np.exp(-(d2[i] - d2[i].min()) * beta)
            w[i] = 0
            total = max(w.sum(), 1e-12)
            h = np.log(total) + beta * (w * (d2[i] - d2[i].min())).sum() / total
            if abs(h - np.log(perplexity)) < 1e-5:
                break
            if h > np.log(perplexity):
                lo, beta = beta, beta * 2 if hi == np.inf else (beta + hi) / 2
            else:
                hi, beta = beta, (beta + lo) / 2
        p[i] = w / total
    return (p + p.T) / (2 * n)


def _tsne(x: np.ndarray, y: np.ndarray, perplexity: float, learning_rate: float, rounds: int) -> np.ndarray:
    n = len(x)
    d2 = np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0)
    p = np.maximum(_affinities(d2, min(perplexity, max(2.0, (n - 1) / 3))), 1e-12)
    y = y / (y.std(0) + 1e-12) * 1e-4
    step = np.zeros_like(y)
    for t in range(rounds):
        q = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        w = ((12 if t < 250 else 1) * p - q / q.sum()) * q
        grad = 4 * ((np.diag(w.sum(1)) - w) @ y)
        step = (0.5 if t < 250 else 0.8) * step - learning_rate * grad
        y = y + step
    return y


def smooth_distances(dist: np.ndarray, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A row's distance to its nearest neighbour, and the bandwidth at which its memberships sum to log2 of their number."""
    target = np.log2(max(dist.shape[1], 2))
    near = np.where(dist > 0, dist, np.inf).min(1)
    near = np.where(np.isfinite(near), near, 0)
    lo, hi, width = np.zeros(len(dist)), np.full(len(dist), np.inf), np.ones(len(dist))
    for _ in range(rounds):
        total = np.exp(-np.maximum(dist - near[:, None], 0) / width[:, None]).sum(1)
        over = total > target
        hi, lo = np.where(over, width, hi), np.where(over, lo, width)
        width = np.where(np.isfinite(hi), (lo + hi) / 2, width * 2)
    return near, np.maximum(width, 1e-3 * np.maximum(dist.mean(1), 1e-12))


def fuzzy_union(n: int, head: np.ndarray, tail: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Undirected edges and weights: an edge stands if either row holds it, ``a + b - a * b``."""
    lo, hi = np.minimum(head, tail), np.maximum(head, tail)
    code, at = np.unique(lo * n + hi, return_inverse=True)
    absent = np.ones(len(code))
    np.multiply.at(absent, at, 1 - weight)
    return code // n, code % n, 1 - absent


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """``a, b`` of ``1 / (1 + a * d ** 2b)``, least squares to 1 within ``min_dist`` and a falling exponential beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([0.0, 0.0]), 1e-2  # logarithms of a and b

    def residual(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(p[0]) * x ** (2 * np.exp(p[1]))) - want

    for _ in range(200):
        r = residual(p)
        jac = np.stack([(residual(p + d) - r) / 1e-6 for d in np.eye(2) * 1e-6], 1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), -jac.T @ r)
        better = (residual(p + step) ** 2).sum() < (r**2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 4)
    return float(np.exp(p[0])), float(np.exp(p[1]))


def _umap(x: np.ndarray, y: np.ndarray, neighbours: int, min_dist: float, metric: str, rounds: int, seed: int) -> np.ndarray:
    """A fuzzy nearest-neighbour graph with a bandwidth for each row, laid out by attraction along its edges and repulsion from random rows."""
    n, rng = len(x), np.random.default_rng(seed)
    if n < 3:
        return y
    k = min(neighbours, n - 1)
    near, dist = np.empty((n, k), np.int64), np.empty((n, k))
    for at in range(0, n, 1024):  # exact neighbours, a block of rows at a time
        d = pairwise(x[at : at + 1024], x, metric)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        near[at : at + 1024] = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist[at : at + 1024] = np.take_along_axis(d, near[at : at + 1024], 1)
    dist = np.where(np.isfinite(dist), dist, dist[np.isfinite(dist)].max(initial=1.0))
    least, width = smooth_distances(dist)
    weight = np.exp(-np.maximum(dist - least[:, None], 0) / width[:, None])
    head, tail, w = fuzzy_union(n, np.repeat(np.arange(n), k), near.ravel(), weight.ravel())
    a, b = curve(min_dist)
    y = 10 * y / (np.abs(y).max() + 1e-12) + rng.normal(0, 1e-4, y.shape)
    share = w / w.max()
    for t in range(rounds):
        rate = 1 - t / rounds
        e = np.flatnonzero(rng.random(len(w)) < share)  # an edge is drawn as often as it weighs
        gap = y[head[e]] - y[tail[e]]
        s = np.maximum((gap**2).sum(1, keepdims=True), 1e-12)
        pull = np.clip(-2 * a * b * s ** (b - 1) / (1 + a * s**b) * gap, -4, 4)
        move = np.zeros_like(y)
        np.add.at(move, head[e], pull)
        np.add.at(move, tail[e], -pull)
        for end in (head[e], tail[e]):
            for _ in range(5):
                gap = y[end] - y[rng.integers(0, n, len(e))]
                s = (gap**2).sum(1, keepdims=True)
                np.add.at(move, end, np.where(s > 0, np.clip(2 * b * gap / ((0.001 + s) * (1 + a * s**b)), -4, 4), 0))
        y = y + rate * move / (2 * k)
    return y


def _placed(rows: DataFrame, mean: list[float], vectors: np.ndarray, points: np.ndarray, near: int = 5) -> DataFrame:
    """Rows at the mean of their nearest anchors' points, weighted by inverse squared distance: ``id, point``."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast((np.asarray(mean), vectors, points))  # the rows of the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, v, p = shared.value
        size, k = (v**2).sum(1), min(near, len(v))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1) - centre
                d = np.maximum((x**2).sum(1)[:, None] + size - 2 * x @ v.T, 0)
                best = np.argpartition(d, k - 1, axis=1)[:, :k]
                w = 1 / (np.take_along_axis(d, best, 1) + 1e-9)
                y = (p[best] * w[:, :, None]).sum(1) / w.sum(1)[:, None]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(y), pa.list_(pa.float64()))], ["id", "point"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.where("embedding is not null").select("id", V.vector("embedding").alias("embedding")).mapInArrow(run, f"id {kind}, point array<double>")


def _laid_out(index: SimilarityIndex, method: str, num_dims: int, fit_rows: int | None, layout) -> Projection:
    """Lay out ``fit_rows`` rows, chosen by a hash of their id, or all, and place the others among them."""
    kind = index.base.schema["id"].dataType.simpleString()
    index.dimensions  # noqa: B018  raises for unlike lengths
    rows = index.rows.select("id", "embedding")
    if fit_rows is not None:
        rows = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    rows = sorted(rows.collect(), key=lambda r: r.id)  # what the caller allows
    if not rows:
        return _empty(index, method)
    x = np.array([r.embedding for r in rows])
    mean = x.mean(0)
    x = x - mean
    _, _, parts = np.linalg.svd(x, full_matrices=False)
    y = x @ parts[:num_dims].T
    y = layout(x @ parts[:50].T, np.hstack([y, np.zeros((len(y), num_dims - y.shape[1]))]))
    own = index.base.sparkSession.createDataFrame([(r.id, [float(v) for v in p]) for r, p in zip(rows, y, strict=True)], f"id {kind}, point array<double>")
    trained = own.select("id")
    if fit_rows is None or len(rows) < fit_rows:
        points = own
    else:
        others = index.rows.join(F.broadcast(trained), "id", "left_anti")  # fit_rows ids
        points = own.unionByName(_placed(others, mean.tolist(), x, y))
    return Projection(points, method, mean.tolist(), None, len(rows), (x, y), trained)


def register_method(name: str, method: Callable[..., Projection]) -> None:
    """Add ``method(index, num_dims, **options) -> Projection`` under ``name``, or replace one."""
    METHODS[name] = method


def _tsne_method(index: SimilarityIndex, num_dims: int, *, fit_rows: int | None = 3000, perplexity: float = 30.0, learning_rate: float = 200.0, max_iters: int = 1000) -> Projection:
    return _laid_out(index, "tsne", num_dims, fit_rows, lambda x, y: _tsne(x, y, perplexity, learning_rate, max_iters))


def _umap_method(index: SimilarityIndex, num_dims: int, *, fit_rows: int | None = 3000, num_neighbors: int = 15, min_dist: float = 0.1, metric: str = "euclidean", max_iters: int = 200, seed: int = 0) -> Projection:
    return _laid_out(index, "umap", num_dims, fit_rows, lambda x, y: _umap(x, y, num_neighbors, min_dist, metric, max_iters, seed))


def _pca_method(index: SimilarityIndex, num_dims: int) -> Projection:
    return pca(index, num_dims)


def _manual_method(index: SimilarityIndex, num_dims: int, *, points: DataFrame) -> Projection:
    return manual(points)


for _name, _method in (("pca", _pca_method), ("manual", _manual_method), ("tsne", _tsne_method), ("umap", _umap_method)):
    register_method(_name, _method)


def visualize(index: SimilarityIndex, method: str = "pca", num_dims: int = 2, **options) -> Projection:
    """A projection by ``pca``, ``tsne`` or ``umap``, of given ``points`` (``manual``), or by a registered method.

    PCA uses all rows.  The layouts are fitted on the driver: on ``fit_rows`` rows
    (3,000 unless told otherwise), the others being placed among them, or with
    ``fit_rows=None`` on all rows, which takes their vectors, and for t-SNE all
    their distances, into the driver's memory.  Every row gets a point.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    return METHODS[method](index, num_dims, **options)


def bounds(points: DataFrame) -> DataFrame:
    """``lo, hi`` over all coordinates of all points."""
    return points.select(F.explode("point").alias("x")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def grid(points: DataFrame, cells: int = 64) -> DataFrame:
    """Points with ``cell_x, cell_y`` of a square grid over the bounds, for pruned box queries."""
    b = F.broadcast(bounds(points))  # one row
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))

    def cell(k: int):
        return F.least(F.coalesce(F.floor((F.get("point", k) - F.col("lo")) / width * cells), F.lit(0)), F.lit(cells - 1)).cast("int")

    return points.join(b).select("id", "point", cell(0).alias("cell_x"), cell(1).alias("cell_y"))


def point_types(projection: Projection, dups: DataFrame) -> DataFrame:
    """``id, point, type``: unique, nearest or duplicate for a scatter plot; points without a decision are ``other``."""
    return projection.points.join(dups.select("id", "type"), "id", "left").withColumn("type", F.coalesce("type", F.lit("other")))
