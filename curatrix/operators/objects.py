"""Labelled regions nested inside samples: flattening, pooling and box matching."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions import vectors as V
from curatrix.operators import scores
from curatrix.session import ship_package

log = logging.getLogger(__name__)
#: What to do with samples whose label list is empty or null.
MISSING = ("skip", "image", "error")


def flatten_labels(samples: DataFrame, labels: str, *, sample_id: str = "sample_id", handle_missing: str = "skip") -> DataFrame:
    """One row a label: ``sample_id, idx`` and the label's fields; label order is kept.

    Samples without labels are skipped, kept as one row of nulls (``image``), or
    refused (``error``).
    """
    if handle_missing not in MISSING:
        raise ValueError(f"handle_missing must be one of {', '.join(MISSING)}")
    if handle_missing == "error" and not samples.where(F.coalesce(F.size(labels), F.lit(0)) <= 0).isEmpty():
        raise ValueError("some samples have no labels")
    explode = F.posexplode_outer if handle_missing == "image" else F.posexplode
    return samples.select(sample_id, explode(labels).alias("idx", "_l")).select(sample_id, "idx", "_l.*")


def nest_labels(rows: DataFrame, *, sample_id: str = "sample_id", order: str = "idx", name: str = "labels") -> DataFrame:
    """The reverse of ``flatten_labels``: a list of labels for each sample, in order."""
    fields = [c for c in rows.columns if c != sample_id]
    return rows.groupBy(sample_id).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(name))


def filter_labels(samples: DataFrame, labels: str, keep: Callable) -> DataFrame:
    """``samples`` with only the labels for which ``keep(label)`` holds; samples left without any go."""
    return samples.withColumn(labels, F.filter(labels, keep)).where(F.size(labels) > 0)


def label_owners(samples: DataFrame, labels: str, wanted: DataFrame, *, sample_id: str = "sample_id", allow_missing: bool = True, warn_missing: bool = False) -> DataFrame:
    """``label_id, sample_id`` of the label ids in ``wanted(label_id)``; unknown ones are left out, raise, or are warned of."""
    flat = samples.select(sample_id, F.explode(F.transform(labels, lambda x: x["id"])).alias("label_id"))
    ids = wanted.select("label_id").distinct()
    if not allow_missing or warn_missing:
        lost = ids.join(flat.select("label_id"), "label_id", "left_anti").count()
        if lost and not allow_missing:
            raise ValueError(f"{lost} labels are not in {labels!r}")
        if lost:
            log.warning("%d labels are not in %r", lost, labels)
    return flat.join(ids, "label_id", "left_semi")


def labels_of(reference: DataFrame, rows: DataFrame, *, sample_id: str = "sample_id") -> DataFrame:
    """``rows(sample_id, ...)`` in the order of ``reference(sample_id, pos)``; samples without rows stay, with nulls."""
    return reference.select(sample_id, "pos").join(rows, sample_id, "left").orderBy("pos")


def write_label_field(samples: DataFrame, labels: str, values: DataFrame, field: str, *, sample_id: str = "sample_id") -> DataFrame:
    """``samples`` with ``field`` of the labels in ``values(label_id, <field>)`` set; other labels keep theirs, or null.

    Values are gathered for each sample (as many as it has labels) and looked up
    by label id inside the list, so samples are joined once and not flattened.
    """
    kind = values.schema[field].dataType.simpleString()
    owners = label_owners(samples, labels, values, sample_id=sample_id)
    maps = owners.join(values.select("label_id", F.col(field).alias("_v")).dropDuplicates(["label_id"]), "label_id").groupBy(sample_id).agg(F.map_from_entries(F.collect_list(F.struct("label_id", "_v"))).alias("_m"))
    item = samples.schema[labels].dataType.elementType
    names = [n for n in item.names if n != field]

    def put(x: Column) -> Column:
        old = x[field] if field in item.names else F.lit(None).cast(kind)
        new = F.when(F.coalesce(F.map_contains_key("_m", x["id"]), F.lit(False)), F.element_at("_m", x["id"])).otherwise(old)
        return F.struct(*[x[n].alias(n) for n in names], new.alias(field))

    return samples.join(maps, sample_id, "left").withColumn(labels, F.transform(labels, put)).drop("_m")


def clear_label_field(samples: DataFrame, labels: str, ids: DataFrame, field: str, *, sample_id: str = "sample_id", by: str = "label_id") -> DataFrame:
    """``samples`` with ``field`` null in the labels of ``ids(label_id)``, or in all of samples (``by="sample_id"``)."""
    kind = samples.schema[labels].dataType.elementType[field].dataType.simpleString()
    if by == "sample_id":
        gone = samples.join(ids.select(sample_id).distinct(), sample_id, "left_semi").select(F.explode(F.transform(labels, lambda x: x["id"])).alias("label_id"))
    else:
        gone = ids.select("label_id").distinct()
    return write_label_field(samples, labels, gone.withColumn(field, F.lit(None).cast(kind)), field, sample_id=sample_id)


def samples_by_first_label(ranks: DataFrame, owners: DataFrame, *, sample_id: str = "sample_id") -> DataFrame:
    """``sample_id, rank``: samples in the order of their first label in ``ranks(id, rank)``, each once.

    ``owners`` is ``label_id, sample_id``.
    """
    own = owners.select(F.col("label_id").alias("id"), sample_id)
    return ranks.select("id", "rank").join(own, "id").groupBy(sample_id).agg(F.min("rank").alias("rank")).orderBy("rank")


def pool(rows: DataFrame, *, sample_id: str = "sample_id", embedding: str = "embedding", aggregate: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``sample_id, embedding``: the mean vector of a sample's regions; null vectors are left out.

    ``aggregate`` maps a sample's vectors, one a row, to one vector instead; it
    gets all regions of a sample in one task.
    """
    kept = rows.where(F.col(embedding).isNotNull())
    if aggregate is None:
        return kept.groupBy(sample_id).agg(V.mean_of(V.vector(embedding)).alias("embedding"))
    ship_package(rows.sparkSession)
    kind = rows.schema[sample_id].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({sample_id: group[sample_id].iloc[:1], "embedding": [[float(x) for x in aggregate(np.array(group["embedding"].tolist()))]]})

    return kept.select(sample_id, V.vector(embedding).alias("embedding")).groupBy(sample_id).applyInPandas(run, f"`{sample_id}` {kind}, embedding array<double>")


#: Rows that are matched at once, and pairs whose overlap is computed at once; a sample is never cut.
ROWS, PAIRS = 65_536, 1_000_000
_SIDES = ("_x", "_y", "_w", "_h")


def _overlaps(box: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``boxes.iou`` of rows ``i`` and ``j`` of ``box``, rounded; like there, missing numbers are left out of minima and maxima."""
    a, b = box[i].T, box[j].T
    w = np.fmin(a[0] + a[2], b[0] + b[2]) - np.fmax(a[0], b[0])
    h = np.fmin(a[1] + a[3], b[1] + b[3]) - np.fmax(a[1], b[1])
    both = np.fmax(w, 0.0) * np.fmax(h, 0.0)
    union = a[2] * a[3] + b[2] * b[3] - both
    found = union > 0
    return np.round(np.where(found, both / np.where(found, union, 1.0), 0.0), V.PLACES)


def _one_to_one(group: np.ndarray, side: np.ndarray, box: np.ndarray, confidence: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``gt, pred, iou`` by row: of rows in the order of their group, side (0: ground truth) and id."""
    gt, pred = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    first, last = (np.searchsorted(group[pred], group[gt], s) for s in ("left", "right"))
    many = last - first
    ends = np.cumsum(many)
    parts, at = [], 0
    while at < len(gt):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = many[at:to]
        j = pred[np.arange(n.sum()) + np.repeat(first[at:to] - (np.cumsum(n) - n), n)]
        i = np.repeat(gt[at:to], n)
        iou = _overlaps(box, i, j)
        keep = iou >= limit
        parts.append((i[keep], j[keep], iou[keep]))
        at = to
    if not parts:
        return gt[:0], gt[:0], np.empty(0)
    i, j, iou = (np.concatenate(z) for z in zip(*parts, strict=True))
    alone = (np.bincount(i, minlength=len(side))[i] == 1) & (np.bincount(j, minlength=len(side))[j] == 1)
    chosen = alone.copy()
    if not alone.all():  # by falling confidence, then id; the box that overlaps most, then the smaller id
        least = np.where(np.isnan(confidence), np.inf, -confidence)
        free = np.ones(len(side), bool)
        for k in np.lexsort((i, -iou, j, least[j])).tolist():
            if not alone[k] and free[i[k]] and free[j[k]]:
                free[i[k]] = free[j[k]] = False
                chosen[k] = True
    return i[chosen], j[chosen], iou[chosen]


def matched_objects(gt: DataFrame, pred: DataFrame, *, limit: float = 0.5, own: tuple[str, ...] = (), theirs: tuple[str, ...] = ()) -> DataFrame:
    """``sample_id, side, gt_id, pred_id, iou``: a row a ground-truth object with its match, if any, and one a prediction without.

    ``own`` are further columns of the ground truth (as ``gt_<name>``), ``theirs`` of
    the predictions (as ``pred_<name>``).  Both tables are shuffled once, by sample, and
    each task matches the samples of a stretch of its rows together.
    """
    ship_package(gt.sparkSession)
    sides = [F.get("bounding_box", k).cast("double").alias(n) for k, n in enumerate(_SIDES)]
    kinds = {"gt_id": gt.schema["id"].dataType, "pred_id": pred.schema["id"].dataType}
    kinds |= {f"gt_{c}": gt.schema[c].dataType for c in own} | {f"pred_{c}": pred.schema[c].dataType for c in theirs}
    names = list(kinds)

    def side(df: DataFrame, prefix: str, k: int, confidence: Column) -> DataFrame:
        mine = [F.col(n.removeprefix(prefix)).alias(n) if n.startswith(prefix) else F.lit(None).cast(kinds[n]).alias(n) for n in names]
        return df.select("sample_id", F.lit(k).cast("byte").alias("side"), *mine, confidence.alias("_c"), *sides)

    both = side(gt, "gt_", 0, F.lit(None).cast("double")).unionByName(side(pred, "pred_", 1, F.col("confidence").cast("double")))
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in both.schema.fields if f.name in ("sample_id", "side")), *(T.StructField(n, kinds[n]) for n in names), T.StructField("iou", T.DoubleType())])

    def match(table: pa.Table, group: np.ndarray) -> pa.Table:
        side = table.column("side").to_numpy()
        box = np.stack([table.column(n).to_numpy() for n in _SIDES], 1)
        i, j, iou = _one_to_one(group, side, box, table.column("_c").to_numpy(), limit)
        other, over, taken = np.full(len(side), -1), np.full(len(side), np.nan), np.zeros(len(side), bool)
        other[i], over[i], taken[j] = j, iou, True
        rows = np.flatnonzero((side == 0) | ~taken)
        other, over = other[rows], over[rows]
        at = pa.array(np.where((other < 0) & (side[rows] == 1), rows, other), mask=(other < 0) & (side[rows] == 0))
        columns = [table.column(n).take(pa.array(rows) if not n.startswith("pred_") else at) for n in schema.names[:-1]]
        return pa.Table.from_arrays([*columns, pa.array(over, mask=other < 0)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, goal = 0, ROWS
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < goal:
                continue
            table, group = _grouped(held)
            last = int(np.searchsorted(group, group[-1]))  # the last sample may go on
            if last:
                yield from match(table.slice(0, last), group[:last]).to_batches()
            held, count = table.slice(last).to_batches(), len(group) - last
            goal = max(ROWS, 2 * count)
        if count:
            yield from match(*_grouped(held)).to_batches()

    return both.repartition("sample_id").sortWithinPartitions("sample_id", "side", "gt_id", "pred_id").mapInArrow(run, schema)


def _grouped(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    """Rows, and the number of each row's sample among them; a null sample is one row."""
    table = pa.Table.from_batches(batches).combine_chunks()
    ids = table.column("sample_id").combine_chunks()
    same = pc.fill_null(pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)), False)
    return table, np.concatenate([[0], np.cumsum(~same.to_numpy(zero_copy_only=False))])


def match_boxes(gt: DataFrame, pred: DataFrame, *, limit: float = 0.5) -> DataFrame:
    """``sample_id, gt_id, pred_id, iou``: one-to-one matches, whatever the classes.

    Inputs are ``(sample_id, id, bounding_box[, confidence])``.  Of the pairs of a
    sample that overlap by ``limit``, predictions take, by falling confidence, the
    free box that they overlap most.  Ties go to the smaller id.
    """
    return matched_objects(gt, pred, limit=limit).where("iou is not null").select("sample_id", "gt_id", "pred_id", "iou")


def object_mistakenness(gt: DataFrame, pred: DataFrame, *, limit: float = 0.5, confident: float = 0.95, use_logits: bool = False) -> DataFrame:
    """``sample_id, id, side, mistakenness, mistakenness_loc, possible_spurious, possible_missing`` for all objects.

    Matched ground-truth objects (``side = 'gt'``) get class and location scores;
    unmatched ones are possibly spurious.  Unmatched predictions
    (``side = 'pred'``) over ``confident`` are possibly missing from the ground
    truth; other predictions are left out.
    """
    score = "logits" if use_logits else "confidence"
    m = matched_objects(gt, pred, limit=limit, own=("label",), theirs=("label", score))
    c = F.exp(-scores.hardness(F.col("pred_logits"))) if use_logits else F.col("pred_confidence")
    found, own = F.col("iou").isNotNull(), F.col("side") == 0
    return m.where(own | (c > confident)).select(
        "sample_id", F.when(own, F.col("gt_id")).otherwise(F.col("pred_id")).alias("id"), F.when(own, "gt").otherwise("pred").alias("side"),
        F.when(found, (F.when(F.col("pred_label") == F.col("gt_label"), -1.0).otherwise(1.0) * c + 1) / 2).alias("mistakenness"),
        F.when(found, scores.location_mistakenness(F.col("iou"), c, limit)).alias("mistakenness_loc"), (own & ~found).alias("possible_spurious"), (~own).alias("possible_missing"),
    )


def sample_mistakenness(samples: DataFrame, objects: DataFrame) -> DataFrame:
    """``sample_id, mistakenness, n_missing, n_spurious``: the largest object score, -1 without a match, and counts."""
    agg = objects.groupBy("sample_id").agg(F.max("mistakenness").alias("m"), F.count_if("possible_missing").alias("n_missing"), F.count_if("possible_spurious").alias("n_spurious"))
    out = samples.select("sample_id").join(agg, "sample_id", "left")
    return out.select("sample_id", F.coalesce("m", F.lit(-1.0)).alias("mistakenness"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("n_spurious", F.lit(0)).alias("n_spurious"))


def with_missing(gt: DataFrame, pred: DataFrame, objects: DataFrame) -> DataFrame:
    """Ground truth with copies of the predictions that are possibly missing from it."""
    lost = objects.where("possible_missing").select("sample_id", "id")
    copies = pred.join(lost, ["sample_id", "id"], "left_semi")
    return gt.unionByName(copies.select(*gt.columns))
