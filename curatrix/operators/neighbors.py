"""Similarity queries: ordering by distance, nearest neighbours and radius neighbours.

Queries of a few vectors are literals in one JVM expression over the index.
All-pairs operators are exact: rows are hashed into tiles, every pair of tiles is
a task that multiplies blocks of ``BLOCK`` rows, and only the k best (or the pairs
within the radius) leave it.  ``radius_neighbors`` can prune pairs of k-means cells
by the triangle inequality instead, which stays exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from curatrix.functions import vectors as V
from curatrix.operators.index import SimilarityIndex
from curatrix.plans.profiles import PROFILES
from curatrix.session import materialize, ship_package

BLOCK = 2048
#: Rows of a task's side at most: 32 MB of 64-dimensional vectors.
TILE = 65_536
#: Pairs that are decided in double precision at a time, and rows of a batch of results.
PAIRS = 65_536
AGGREGATIONS = ("mean", "post-mean", "post-min", "post-max")


def pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``, rounded; undefined ones are infinite."""
    if metric == "cosine":
        length = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        d = np.where(length > 0, 1 - (a @ b.T) / np.where(length > 0, length, 1), np.inf)
    elif metric in ("dotproduct", "innerproduct"):
        d = -(a @ b.T)
    else:
        d = np.empty((len(a), len(b)))
        for i, x in enumerate(a):
            if metric == "euclidean":
                d[i] = np.sqrt(((b - x) ** 2).sum(1))
            elif metric == "l1":
                d[i] = np.abs(b - x).sum(1)
            elif metric == "hamming":
                d[i] = (b != x).sum(1)
            else:
                either = ((b != 0) | (x != 0)).sum(1)
                d[i] = np.where(either > 0, ((b != 0) != (x != 0)).sum(1) / np.maximum(either, 1), 0)
    return np.round(d, V.PLACES)


def _products(a: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, Callable] | None:
    """Single-precision factors whose products rank pairs by distance, and ``cut(dist)``.

    ``cut(dist)`` is a product, one for each row of ``a``, that no pair within
    ``dist`` falls below: it leaves room for the rounding of single precision and of
    distances.  What passes is decided by ``_exact``.  None for metrics that are no
    products, and for vectors too long for single precision.
    """
    room = (a.shape[1] + 16) * 1.2e-7
    if metric == "cosine":
        parts = []
        for x in (a, b):
            length = np.linalg.norm(x, axis=1, keepdims=True)
            if not np.isfinite(length).all():
                return None
            parts.append((x / np.where(length > 0, length, 1)).astype(np.float32))
        return *parts, lambda dist: (1 - np.asarray(dist) - room - 1e-8) + np.zeros(len(a))
    if metric not in ("euclidean", "dotproduct", "innerproduct") or not len(a) or not len(b):
        return None
    if metric == "euclidean":
        shift = a.mean(0)
        a, b = a - shift, b - shift
    size_a, size_b = (a**2).sum(1), (b**2).sum(1)
    top_a, top_b = size_a.max(), size_b.max()
    if not (top_a < 1e30 and top_b < 1e30):
        return None
    if metric != "euclidean":
        slack = room * (top_a * top_b) ** 0.5 + 1e-8
        return a.astype(np.float32), b.astype(np.float32), lambda dist: (-np.asarray(dist) - slack) + np.zeros(len(a))
    slack = room * (top_a**0.5 + top_b**0.5) ** 2
    left = np.concatenate([a, np.ones((len(a), 1))], 1).astype(np.float32)
    right = np.concatenate([b, -size_b[:, None] / 2], 1).astype(np.float32)

    def cut(dist) -> np.ndarray:
        reach = np.asarray(dist) + 1e-8
        return np.where(reach < 0, np.inf, (size_a - reach**2) / 2 - slack)

    return left, right, cut


def _exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray, metric: str) -> np.ndarray:
    """``pairwise`` of the given pairs only (of metrics that ``_products`` knows), a slice of them at a time."""
    out = np.empty(len(row))
    for at in range(0, len(row), PAIRS):
        x, y = a[row[at : at + PAIRS]], b[col[at : at + PAIRS]]
        if metric == "euclidean":
            d = np.sqrt(((x - y) ** 2).sum(1))
        else:
            d = -np.einsum("ij,ij->i", x, y)
            if metric == "cosine":
                length = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
                d = np.where(length > 0, 1 + d / np.where(length > 0, length, 1), np.inf)
        out[at : at + PAIRS] = np.round(d, V.PLACES)
    return out


def _candidates(a: np.ndarray, b: np.ndarray, product: np.ndarray | None, cut: np.ndarray | None, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, col, dist`` of the pairs whose product reaches ``cut``; of all pairs without products."""
    if product is not None:
        found = product >= cut[:, None]
        many = np.count_nonzero(found)
        if many <= found.size // 8:
            at = np.flatnonzero(found)
            row, col = at // len(b), at % len(b)
            return row, col, _exact(a, b, row, col, metric)
    d = pairwise(a, b, metric)
    row, col = np.nonzero(np.isfinite(d) if product is None else found)
    return row, col, d[row, col]


def pairs_within(a: np.ndarray, b: np.ndarray, thresh: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``row, col, dist`` of all pairs within ``thresh``, a block of ``BLOCK`` rows and columns at a time."""
    form = _products(a, b, metric)
    cut = None if form is None else form[2](thresh).astype(np.float32)
    for i in range(0, len(a), BLOCK):
        for j in range(0, len(b), BLOCK):
            x, y = a[i : i + BLOCK], b[j : j + BLOCK]
            product = None if form is None else form[0][i : i + BLOCK] @ form[1][j : j + BLOCK].T
            row, col, dist = _candidates(x, y, product, None if cut is None else cut[i : i + BLOCK], metric)
            keep = dist <= thresh
            if keep.any():
                yield row[keep] + i, col[keep] + j, dist[keep]


def nearest_of(a: np.ndarray, b: np.ndarray, ai: np.ndarray, bi: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, col, dist`` of the ``k`` nearest rows of ``b`` for each row of ``a``, ties by id; equal ids are no pair.

    Columns are gone through in blocks.  Once a row has k neighbours, only products
    that reach the worst of them are looked at.
    """
    form = _products(a, b, metric)
    out = []
    for i in range(0, len(a), BLOCK):
        x, xi = a[i : i + BLOCK], ai[i : i + BLOCK]
        row, col, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        worst = np.full(len(x), np.inf)
        for j in range(0, len(b), BLOCK):
            y = b[j : j + BLOCK]
            product = cut = None
            if form is not None:
                product = form[0][i : i + BLOCK] @ form[1][j : j + BLOCK].T
                bound = np.full(len(a), np.inf)
                bound[i : i + BLOCK] = worst
                cut = form[2](bound)[i : i + BLOCK]
                new = np.isinf(worst)
                if new.any() and k + 1 < len(y):  # a row's own id may be among the k + 1 best
                    least = np.partition(product[new], len(y) - k - 1, axis=1)[:, len(y) - k - 1]
                    far = _farthest(x[new], y, product[new], least, metric)
                    cut[new] = form[2](_spread(len(a), i, new, far))[i : i + BLOCK][new]
                cut = cut.astype(np.float32)
            r, c, d = _candidates(x, y, product, cut, metric)
            keep = (d <= worst[r]) & np.isfinite(d) & (xi[r] != bi[c + j])
            row, col, dist = (np.concatenate([u, v]) for u, v in ((row, r[keep]), (col, c[keep] + j), (dist, d[keep])))
            order = np.lexsort((bi[col], dist, row))
            row, col, dist = row[order], col[order], dist[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, dist = row[best], col[best], dist[best]
            last = np.searchsorted(row, np.arange(len(x)), "right")
            full = np.bincount(row, minlength=len(x)) == k
            worst[full] = dist[last[full] - 1]
        out.append((row + i, col, dist))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _farthest(x: np.ndarray, y: np.ndarray, product: np.ndarray, least: np.ndarray, metric: str) -> np.ndarray:
    """The largest exact distance among the pairs of each row whose product reaches ``least``; that of none is infinite."""
    row, col = np.nonzero(product >= least[:, None])
    far = np.full(len(x), -np.inf)
    np.maximum.at(far, row, _exact(x, y, row, col, metric))
    return far


def _spread(n: int, at: int, where: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.full(n, np.inf)
    out[at + np.flatnonzero(where)] = values
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("embedding").combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _ids(table: pa.Table) -> np.ndarray:
    """Ids that NumPy can order: text by code points, as Spark does."""
    ids = table.column("id").to_numpy()
    return ids.astype(str) if ids.dtype == object else ids


def tile_rows(rows: int, parallel: int) -> int:
    """Rows of a tile's side: larger tiles copy vectors to fewer tasks, smaller ones keep all cores busy."""
    return int(min(TILE, max(BLOCK, rows / max(1.0, (2 * parallel) ** 0.5))))


def _block_pairs(index: SimilarityIndex, kernel: Callable, schema: T.StructType, half: bool, queries: DataFrame | None = None) -> DataFrame:
    """Apply ``kernel(queries, points, same_tile)`` to all pairs of tiles; with ``half`` to one of each mirrored pair.

    Rows are hashed into tiles; a task gets a pair of tiles and goes through
    their blocks of ``BLOCK`` rows, so its memory is two tiles and one product of
    two blocks, and a vector is copied once for each tile it meets.  What a kernel
    yields leaves the task at once.
    """
    ship_package(index.base.sparkSession)
    index.dimensions  # noqa: B018  raises for unlike lengths
    points = index.centred().select("id", "pos", "embedding")
    asked = points if queries is None else queries.select("id", "pos", "embedding")
    parallel = index.base.sparkSession.sparkContext.defaultParallelism
    size = index.size()
    n = max(1, -(-size // tile_rows(size, parallel)))
    if queries is None:
        m = n
    else:
        size = asked.count()
        m = max(1, -(-size // tile_rows(size, parallel)))

    def tile(k: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")

    q = asked.withColumn("_q", tile(m)).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_side", F.lit(0))
    p = points.withColumn("_p", tile(n)).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("_side", F.lit(1))
    both = q.unionByName(p)
    if half:  # a tile that meets itself comes once and is both sides
        both = both.where("_q < _p or (_q = _p and _side = 0)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        same = half and table.column("_q")[0].as_py() == table.column("_p")[0].as_py()
        if same:
            a = b = table
        else:
            side = table.column("_side").to_numpy()
            a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        del table
        if a.num_rows and b.num_rows:
            for part in kernel(a, b, same):
                yield from part.to_batches(max_chunksize=PAIRS)

    return both.groupBy("_q", "_p").applyInArrow(run, schema)


def _nearest(k: int, metric: str) -> Callable:
    """Kernel of the ``k`` nearest points of each query of a tile: ``query_id, id, dist``."""

    def kernel(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.Table]:
        row, col, dist = nearest_of(_matrix(a), _matrix(b), _ids(a), _ids(b), k, metric)
        yield pa.Table.from_arrays([a.column("id").take(pa.array(row)), b.column("id").take(pa.array(col)), pa.array(dist)], ["query_id", "id", "dist"])

    return kernel


def _best(parts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of the rows that blocks gave for each query."""
    order = W.partitionBy("query_id").orderBy("dist", "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def _pair_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("dist", T.DoubleType())])


def kneighbors(index: SimilarityIndex, k: int, queries: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest rows of each query: ``query_id, rank, id, dist``, ties by id.

    Without ``queries(id, pos, embedding)`` every row of the view is a query; a
    row is never its own neighbour.  Fewer rows than ``k`` give what there is.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    schema = _pair_schema(index.base.schema["id"].dataType)
    return _best(_block_pairs(index, _nearest(k, index.metric), schema, False, queries), k)


def kneighbors_cells(index: SimilarityIndex, k: int, queries: DataFrame | None = None, *, cells: int = 64, probes: int = 40, fit_rows: int = 50_000, seed: int = 1234) -> DataFrame:
    """``kneighbors`` that compares a query only with the rows of its ``probes`` nearest cells.

    Cells are k-means centres (at most ``cells``) fitted on up to ``fit_rows``
    rows chosen by a hash of their id; every row is indexed and every query
    answered.  A cell of more than ``BLOCK`` rows is cut into blocks, so a hot
    cell is many tasks.  Distances are exact; neighbours outside the probed
    cells are missed, and a query may get fewer than ``k``.  The defaults suit
    vectors without clusters; clustered ones reach the same recall with fewer
    probes, which should be measured.
    """
    if k < 1 or probes < 1 or cells < 1:
        raise ValueError("k, cells and probes must be at least 1")
    spark = index.base.sparkSession
    ship_package(spark)
    index.dimensions  # noqa: B018
    points = index.centred().select("id", "pos", "embedding")
    asked = points if queries is None else queries.select("id", "pos", "embedding")
    schema = _pair_schema(index.base.schema["id"].dataType)
    sample = points.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select(array_to_vector("embedding").alias("features"))
    n = sample.count()
    if not n:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "id", "dist")
    centres = np.array(KMeans(k=min(cells, n), seed=seed).fit(sample).clusterCenters())
    shared = spark.sparkContext.broadcast(centres)  # at most ``cells`` vectors

    def placed(rows: DataFrame, many: int) -> DataFrame:
        """Rows with the list of their ``many`` nearest cells."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            size, m = (c**2).sum(1), min(many, len(c))
            for batch in batches:
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                near = np.argsort(size - 2 * x @ c.T, axis=1, kind="stable")[:, :m].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32()))], ["id", "pos", "embedding", "_cells"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_cells", T.ArrayType(T.IntegerType()))]))

    held = placed(points, 1).withColumn("_c", F.get("_cells", 0)).drop("_cells")
    sizes = held.groupBy("_c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))  # a row a cell
    p = held.join(F.broadcast(sizes), "_c").withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")).withColumn("_q", F.lit(0))
    want = placed(asked, probes).withColumn("_c", F.explode("_cells")).drop("_cells")
    loads = want.groupBy("_c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_m"))
    q = want.join(F.broadcast(sizes), "_c").join(F.broadcast(loads), "_c").withColumn("_q", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_m")).cast("int"))
    q = q.withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_side", F.lit(0))
    p = p.join(F.broadcast(loads), "_c").withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).withColumn("_side", F.lit(1))
    columns = ["_c", "_q", "_p", "_side", "id", "pos", "embedding"]
    kernel = _nearest(k, index.metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("_side").to_numpy()
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if a.num_rows and b.num_rows:
            for part in kernel(a, b, False):
                yield from part.to_batches(max_chunksize=PAIRS)

    return _best(q.select(*columns).unionByName(p.select(*columns)).groupBy("_c", "_q", "_p").applyInArrow(run, schema), k)


def _within(thresh: float, metric: str) -> Callable:
    """Kernel of all pairs within ``thresh``: ``id_a, id_b, dist``, the row that comes first in the index as a."""

    def kernel(a: pa.Table, b: pa.Table, same: bool) -> Iterator[pa.Table]:
        (ai, bi), (ap, bp) = (_ids(a), _ids(b)), (t.column("pos").to_numpy() for t in (a, b))
        for row, col, dist in pairs_within(_matrix(a), _matrix(b), thresh, metric):
            before = (ap[row] < bp[col]) | ((ap[row] == bp[col]) & (ai[row] < bi[col]))
            # A tile with itself meets every pair twice.
            keep = before if same else ai[row] != bi[col]
            row, col, dist, before = row[keep], col[keep], dist[keep], before[keep]
            x, y = a.column("id").take(pa.array(row)), b.column("id").take(pa.array(col))
            turn = pa.chunked_array([pa.array(before)])
            yield pa.Table.from_arrays([pc.if_else(turn, x, y), pc.if_else(turn, y, x), pa.array(dist)], ["id_a", "id_b", "dist"])

    return kernel


def radius_neighbors(index: SimilarityIndex, thresh: float, *, cells: int = 0, fit_rows: int = 50_000, seed: int = 1234) -> DataFrame:
    """All pairs within ``thresh`` (inclusive): ``id_a, id_b, dist``, the row that comes first in the index as a.

    With ``cells``, rows are assigned to so many k-means centres, and only those
    pairs of cells are compared whose centres and radii leave room for a pair
    within ``thresh``: exact for Euclidean and cosine distances (of which the
    latter is the former between unit vectors), and far less work where vectors
    have clusters.  Cells are cut into tiles like everything else.
    """
    schema = T.StructType([T.StructField("id_a", k := index.base.schema["id"].dataType), T.StructField("id_b", k), T.StructField("dist", T.DoubleType())])
    kernel = _within(thresh, index.metric)
    if not cells:
        return _block_pairs(index, kernel, schema, True)
    if index.metric not in ("cosine", "euclidean"):
        raise ValueError(f"cells can't prune {index.metric} distances")
    return _cell_pairs(index, kernel, schema, V.euclidean_threshold(max(thresh, 0.0)) if index.metric == "cosine" else thresh, cells, fit_rows, seed)


def _cell_pairs(index: SimilarityIndex, kernel: Callable, schema: T.StructType, reach: float, cells: int, fit_rows: int, seed: int) -> DataFrame:
    """Apply ``kernel`` to the pairs of cells that may hold rows within Euclidean distance ``reach``."""
    spark = index.base.sparkSession
    ship_package(spark)
    index.dimensions  # noqa: B018
    cosine = index.metric == "cosine"
    points = index.centred().select("id", "pos", "embedding")
    if cosine:  # vectors without a direction are near nothing
        points = points.where(V.norm(F.col("embedding")) > 0)
    spot = V.unit(F.col("embedding")) if cosine else F.col("embedding")
    sample = points.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select(array_to_vector(spot).alias("features"))
    n = sample.count()
    if not n:
        return spark.createDataFrame([], schema)
    centres = np.array(KMeans(k=min(cells, n), seed=seed).fit(sample).clusterCenters())
    shared = spark.sparkContext.broadcast(centres)  # at most ``cells`` vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            if cosine:
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
            d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1) - 2 * x @ c.T, 0)
            own = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(own)), own]))], ["id", "pos", "embedding", "_c", "_r"])

    placed = materialize(points.mapInArrow(place, T.StructType([*points.schema.fields, T.StructField("_c", T.IntegerType()), T.StructField("_r", T.DoubleType())])), "cells")
    stats = {r[0]: (r[1], r[2]) for r in placed.groupBy("_c").agg(F.max("_r"), F.count("*")).collect()}  # a row a cell
    slack = 1e-6 + reach * 1e-6  # distances are rounded
    pairs = [(i, j) for i in stats for j in stats if i <= j and np.linalg.norm(centres[i] - centres[j]) - stats[i][0] - stats[j][0] <= reach + slack]
    tiles = {i: max(1, -(-stats[i][1] // TILE)) for i in stats}
    # At most ``cells`` squared rows: for each cell, the pairs that it takes part in and on which side.
    meets = spark.createDataFrame([(c, i, j, side, tiles[i], tiles[j]) for i, j in pairs for c, side in ((i, 0), (j, 1))], "_c int, _i int, _j int, _side int, _m int, _n int")
    dealt = placed.join(F.broadcast(meets), "_c")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("_side") == 0, F.col("_m")).otherwise(F.col("_n"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("_side") == 0, F.col("_n")).otherwise(F.col("_m")) - 1)
    dealt = dealt.withColumn("_own", own).withColumn("_other", F.explode(other))
    dealt = dealt.withColumn("_q", F.when(F.col("_side") == 0, F.col("_own")).otherwise(F.col("_other"))).withColumn("_p", F.when(F.col("_side") == 0, F.col("_other")).otherwise(F.col("_own")))
    dealt = dealt.where("_i <> _j or _q <= _p").select("_i", "_j", "_q", "_p", "_side", "id", "pos", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side = table.column("_side").to_numpy()
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        first = table.slice(0, 1).to_pylist()[0]
        same = first["_i"] == first["_j"] and first["_q"] == first["_p"]
        if a.num_rows and b.num_rows:
            for part in kernel(a, b, same):
                yield from part.to_batches(max_chunksize=PAIRS)

    return dealt.groupBy("_i", "_j", "_q", "_p").applyInArrow(run, schema)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1, without a single-task sort.

    Rows are range-partitioned and sorted, numbered within their task, written,
    and moved by the number of rows of the tasks before (a row a task).
    """
    task, at = F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at")
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", task, at), "ranked")
    counts = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = counts.select("_task", F.coalesce(F.sum("_n").over(W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")
    return placed.join(F.broadcast(before), "_task").withColumn(name, place).drop("_task", "_at", "_before")


def sort_by_similarity(
    index: SimilarityIndex, query: list | None = None, *, vectors: list[list[float]] | None = None, k: int | None = None, reverse: bool = False, aggregation: str = "mean", profile: str = "exact"
) -> DataFrame:
    """The view's rows by distance to the query: ``id, rank, dist``.

    ``query`` is a list of ids (inside the view or not), ``vectors`` one of raw
    vectors.  One id is compared in centred space and is at distance 0 from
    itself.  ``mean`` of several ids, and raw vectors, use vectors as they are.
    ``post-*`` aggregates centred distances to every id, its own left out.  Ties
    go to the smaller id; rows without a distance come last.

    ``profile`` names a store: its metrics, limit and order are checked, and if
    it filters after the search (``view_filter="post"``) the view gets those of
    the whole index's first k rows that it holds, which may be fewer.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    if bool(query) == bool(vectors):
        raise ValueError("give ids or vectors")
    store = PROFILES[profile]
    metric, k = store.check(index.metric, k, reverse, index.size)
    view = index.view if store.view_filter == "post" and k else None
    if view is not None:
        index = index.clear()
    e = F.col("embedding")
    if vectors:
        rows, asked = index.rows, [V.literal(list(np.mean(np.asarray(vectors, float), axis=0)))] if aggregation == "mean" else [V.literal(v) for v in vectors]
        ids: list = [None] * len(asked)
    else:
        found = {r.id: list(r.embedding) for r in index.base.where(F.col("id").isin(query)).select("id", "embedding").collect()}  # the given ids
        if lost := [q for q in query if q not in found]:
            raise ValueError(f"not in the index: {lost}")
        if len(query) > 1 and aggregation == "mean":
            rows, asked, ids = index.rows, [V.literal([sum(x) / len(query) for x in zip(*(found[q] for q in query), strict=True)])], [None]
        else:
            rows, ids = index.centred(), list(query)
            mean = index.mean if index.center else None
            asked = [V.literal([x - m for x, m in zip(found[q], mean, strict=True)] if mean else found[q]) for q in query]
    per = [V.distance(e, a, metric) if i is None else F.when(F.col("id") != i, V.distance(e, a, metric)) for a, i in zip(asked, ids, strict=True)]
    if len(per) == 1:
        d = per[0] if ids[0] is None else F.coalesce(per[0], F.lit(0.0))
    else:
        all_ = F.array_compact(F.array(*per))
        d = {"post-min": F.array_min(all_), "post-max": F.array_max(all_), "post-mean": F.aggregate(all_, F.lit(0.0), lambda s, x: s + x) / F.size(all_)}[aggregation]
        d = F.round(d, V.PLACES)
    scored = rows.select("id", d.alias("dist"))
    order = [F.col("dist").desc_nulls_last() if reverse else F.col("dist").asc_nulls_last(), F.col("id")]
    if k is None:
        return ranked(scored, order).select("id", "rank", "dist").orderBy("rank")
    top = scored.orderBy(*order).limit(k)
    if view is not None:
        top = top.join(view.select("id"), "id", "left_semi")
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).select("id", "rank", "dist")  # k rows


def nearest_histogram(index: SimilarityIndex, bins: int = 100) -> DataFrame:
    """Counts of nearest-neighbour distances in equal bins: ``bin, n``; the last bin is closed on both sides."""
    nearest = kneighbors(index, 1).select("dist")
    ends = nearest.agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("dist") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return nearest.join(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row of ends
