"""Immutable similarity indexes and id-aligned index maintenance."""

from __future__ import annotations

import contextlib
import logging
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions import vectors as V
from curatrix.plans.fields import check_scalar_field

log = logging.getLogger(__name__)

COLUMNS = ["id", "sample_id", "label_id", "pos", "embedding"]


@dataclass(frozen=True)
class SimilarityIndex:
    """``rows(id, sample_id, label_id, pos, embedding)`` and how to compare them.

    ``base`` holds the whole index; ``rows`` is its current view.  Distances
    between index rows use vectors centred by the whole index's mean.  Methods
    return new indexes; nothing is changed in place.
    """

    base: DataFrame
    view: DataFrame | None = None
    metric: str = "cosine"
    center: bool = True
    #: The index that ``clear`` goes back to: views may be restricted again.
    outer: SimilarityIndex | None = None
    #: Ids of the collection that the view was made from, if it was made by ``use_view``.
    asked: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        return self.base if self.view is None else self.view

    @property
    def has_view(self) -> bool:
        return self.view is not None

    @cached_property
    def dimensions(self) -> int | None:
        """Length of the vectors, None without rows; vectors of unlike lengths raise."""
        least, most = self.base.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if least != most:
            raise ValueError(f"vectors have {least} to {most} dimensions; an index needs one length")
        return most

    def current_ids(self) -> DataFrame:
        """``id, sample_id, label_id`` of the view, in index order."""
        return self.rows.select("id", "sample_id", "label_id", "pos").orderBy("pos", "id").drop("pos")

    def total_size(self) -> int:
        return self.base.count()

    def missing_size(self) -> int | None:
        """How many ids of the view's collection the index lacks; None without such a collection."""
        return None if self.asked is None else self.missing(self.asked).count()

    def reload(self) -> SimilarityIndex:
        """The index with nothing remembered: its mean, size and view rows are computed anew."""
        return replace(self)

    @cached_property
    def mean(self) -> list[float] | None:
        return V.mean_vector(self.base)

    def centred(self, rows: DataFrame | None = None) -> DataFrame:
        rows = self.rows if rows is None else rows
        if not self.center or self.mean is None:
            return rows
        return rows.withColumn("embedding", V.minus(F.col("embedding"), V.literal(self.mean)))

    def size(self) -> int:
        return self.rows.count()

    def restrict(self, ids: DataFrame, order: str | None = None) -> SimilarityIndex:
        """The rows whose id is in ``ids(id)``; with ``order`` its column becomes ``pos``."""
        if order is None:
            view = self.base.join(ids.select("id").distinct(), "id", "left_semi")
        else:
            view = self.base.drop("pos").join(ids.select("id", F.col(order).cast("long").alias("pos")), "id").select(*COLUMNS)
        return replace(self, view=view.select(*COLUMNS), outer=self, asked=None)

    def use_view(self, collection: DataFrame, *, order: str | None = None, allow_missing: bool = True, warn_missing: bool = False) -> SimilarityIndex:
        """``restrict`` to ``collection(id)``, with checks in both directions.

        With ``allow_missing=False`` rows of the index that the collection lacks,
        or the other way round, raise; with ``warn_missing`` they are warned of.
        A collection that holds the whole index and no more is no view.
        """
        kept, lost, extra = filter_ids(self.base, collection, allow_missing=allow_missing, warn_missing=warn_missing, order=order)
        if not lost and not extra and order is None:
            return replace(self, view=None, outer=self, asked=collection)
        return replace(self, view=kept.select(*COLUMNS), outer=self, asked=collection)

    def clear(self) -> SimilarityIndex:
        """The whole index."""
        return replace(self, view=None, outer=None, asked=None)

    def leave(self) -> SimilarityIndex:
        """What the index was before its last view."""
        return self.outer or self.clear()

    @contextlib.contextmanager
    def viewing(self, collection: DataFrame, **options) -> Iterator[SimilarityIndex]:
        """The index restricted for the length of a ``with`` block."""
        yield self.use_view(collection, **options)

    def values(self, samples: DataFrame, value: str | Column, *, id_col: str = "id", label: str | None = None) -> DataFrame:
        """``id, value`` of the view's rows in index order: a field, or any expression, of their samples.

        For an index of labels, ``label`` names the samples' label list and
        ``value`` a field of its elements.
        """
        if label is None:
            check_scalar_field(samples, value)
            got = samples.select(F.col(id_col).alias("id"), (F.col(value) if isinstance(value, str) else value).alias("value"))
        else:
            flat = samples.select(F.explode(label).alias("_l"))
            got = flat.select(F.col("_l.id").alias("id"), F.col(f"_l.{str(value).removeprefix(label + '.')}").alias("value"))
        return self.rows.select("id", "pos").join(got, "id", "left").orderBy("pos", "id").select("id", "value")

    def missing(self, ids: DataFrame) -> DataFrame:
        """Ids of ``ids(id)`` that the whole index lacks."""
        return ids.select("id").distinct().join(self.base.select("id"), "id", "left_anti")

    def add(self, new: DataFrame, *, overwrite: bool = True, allow_existing: bool = True, warn_existing: bool = False) -> SimilarityIndex:
        """Upsert of ``new(id, embedding[, sample_id, label_id, pos])``.

        Existing ids take the new vector, or keep theirs without ``overwrite``;
        with ``allow_existing=False`` they raise, with ``warn_existing`` they are
        warned of.  New ids repeated in the batch count once (the largest
        ``pos``).  Null ids or vectors are left out.  New rows without ``pos``
        come after all others, in the order of their ids.
        """
        after = (self.base.agg(F.max("pos")).first()[0] or 0) + 1
        new = _conform(new, after)
        if warn_existing and (n := new.join(self.base.select("id"), "id", "left_semi").count()):
            log.warning("%d ids are in the index already", n)
        if not allow_existing and not new.join(self.base.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("some ids are in the index already")
        o, n = self.base.alias("o"), new.alias("n")
        first, second = ("n", "o") if overwrite else ("o", "n")
        pick = [F.coalesce(F.col(f"{first}.{c}"), F.col(f"{second}.{c}")).alias(c) for c in ("sample_id", "label_id")]
        rows = o.join(n, F.col("o.id") == F.col("n.id"), "full").select(
            F.coalesce("o.id", "n.id").alias("id"), *pick, F.coalesce("o.pos", "n.pos").alias("pos"), F.coalesce(f"{first}.embedding", f"{second}.embedding").alias("embedding")
        )
        return replace(self, base=rows, view=None, outer=None, asked=None)

    def remove(self, ids: DataFrame, *, allow_missing: bool = True, warn_missing: bool = False) -> SimilarityIndex:
        """The index without ``ids(id)``; unknown ids raise unless they are allowed, or are warned of."""
        if warn_missing and (n := self.missing(ids).count()):
            log.warning("%d ids are not in the index", n)
        if not allow_missing and not self.missing(ids).isEmpty():
            raise ValueError("some ids are not in the index")
        return replace(self, base=self.base.join(ids.select("id").distinct(), "id", "left_anti").select(*COLUMNS), view=None, outer=None, asked=None)

    def get(self, ids: DataFrame, *, by: str = "id", allow_missing: bool = True) -> DataFrame:
        """Index rows of ``ids(id[, pos])`` in request order; ``by="sample_id"`` gives all labels of samples."""
        if not allow_missing and not ids.select("id").join(self.rows.select(F.col(by).alias("id")), "id", "left_anti").isEmpty():
            raise ValueError("some ids are not in the index")
        request = ids.select(F.col("id").alias("_q"), F.col("pos" if "pos" in ids.columns else "id").alias("request_pos"))
        return self.rows.join(request, F.col(by) == F.col("_q")).drop("_q")


def filter_ids(base: DataFrame, collection: DataFrame, *, allow_missing: bool = True, warn_missing: bool = False, order: str | None = None) -> tuple[DataFrame, int, int]:
    """Rows of ``base(id, ...)`` in ``collection(id)``; how many it lacks of the index, and the index of it.

    Every row of the collection counts, also repeated ones (labels of several
    views); ``order`` names its column that becomes ``pos``.
    """
    ids = collection.select("id", *([F.col(order).cast("long").alias("_p")] if order else []))
    lost = base.select("id").join(ids.select("id").distinct(), "id", "left_anti").count() if not allow_missing or warn_missing or order is None else 0
    extra = ids.select("id").join(base.select("id"), "id", "left_anti").count() if not allow_missing or warn_missing or order is None else 0
    for n, what in ((lost, "rows of the index are not in the collection"), (extra, "rows of the collection are not in the index")):
        if n and not allow_missing:
            raise ValueError(f"{n} {what}")
        if n and warn_missing:
            log.warning("%d %s", n, what)
    kept = base.join(ids, "id")
    return (kept.drop("pos").withColumnRenamed("_p", "pos") if order else kept), lost, extra


def _conform(df: DataFrame, after: int) -> DataFrame:
    have = set(df.columns)
    kind = df.schema["id"].dataType
    cols = [F.col("id"), *[(F.col(c) if c in have else (F.col("id") if c == "sample_id" else F.lit(None).cast(kind))).alias(c) for c in ("sample_id", "label_id")]]
    pos = (F.col("pos") if "pos" in have else F.lit(after)).cast("long").alias("pos")
    # Of repeated ids without a position the last row counts.
    last = F.max_by(F.struct(*[c for c in COLUMNS if c != "id"]), F.struct("pos", "_n")).alias("r")
    rows = df.select(*cols, pos, V.vector("embedding").alias("embedding"), F.monotonically_increasing_id().alias("_n")).where("id is not null and embedding is not null")
    return rows.groupBy("id").agg(last).select("id", *[F.col(f"r.{c}").alias(c) for c in COLUMNS if c != "id"])


def build_index(df: DataFrame, id_col: str, vec_col: str, *, sample_id_col: str | None = None, pos_col: str | None = None, metric: str = "cosine", center: bool = True) -> SimilarityIndex:
    """An index of the rows with an id and a vector; ids are unique.

    The position is that of ``pos_col``, or a numeric id; rows with other ids,
    such as text, stand in the order of their ids.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    kind = df.schema[id_col].dataType
    pos = F.col(pos_col) if pos_col else F.col(id_col) if isinstance(kind, T.NumericType) else F.lit(0)
    rows = df.select(
        F.col(id_col).alias("id"), F.col(sample_id_col or id_col).alias("sample_id"),
        (F.col(id_col) if sample_id_col else F.lit(None).cast(kind)).alias("label_id"),
        pos.cast("long").alias("pos"), V.vector(vec_col).alias("embedding"),
    )
    return SimilarityIndex(rows.where("id is not null and embedding is not null"), metric=metric, center=center)


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    """Whether ``a(id)`` and ``b(id)`` hold the same ids."""
    return a.select("id").join(b.select("id"), "id", "left_anti").isEmpty() and b.select("id").join(a.select("id"), "id", "left_anti").isEmpty()


def ordered_distinct(df: DataFrame, order: str = "pos") -> DataFrame:
    """``id`` and the first ``order`` of each, in that order."""
    return df.groupBy("id").agg(F.min(order).alias(order)).orderBy(order, "id")


def select_ordered(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``df`` in the order of ``ids(id, pos)``; repeated requests repeat rows."""
    return df.join(ids.select(F.col("id").alias(id_col), F.col("pos").alias("request_pos")), id_col).orderBy("request_pos")


def write_field(df: DataFrame, values: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """``df`` with ``field`` from ``values(id_col, field)``; rows without a value keep the old one, if any."""
    new = values.select(id_col, F.col(field).alias("_new")).where("_new is not null")
    old = F.col(field) if field in df.columns else F.lit(None)
    return df.join(new, id_col, "left").withColumn(field, F.coalesce("_new", old)).drop("_new")


def clear_field(df: DataFrame, ids: DataFrame, field: str, id_col: str = "id") -> DataFrame:
    """``df`` with ``field`` null in the rows of ``ids(id_col)``."""
    gone = ids.select(id_col).distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, id_col, "left").withColumn(field, F.when(F.col("_gone").isNull(), F.col(field))).drop("_gone")
