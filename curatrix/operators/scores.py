"""Sample scores: uniqueness, representativeness, hardness and mistakenness."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import vectors as V
from curatrix.operators.index import SimilarityIndex
from curatrix.operators.neighbors import kneighbors

WEIGHTS = (0.6, 0.3, 0.1)


def over_max(df: DataFrame, column: str) -> DataFrame:
    """``column`` divided by its largest value over all rows (0 stays 0); the maximum is one row."""
    top = df.agg(F.max(column).alias("_max"))
    return df.join(F.broadcast(top)).withColumn(column, F.coalesce(F.col(column) / F.nullif("_max", F.lit(0.0)), F.lit(0.0))).drop("_max")


def uniqueness(index: SimilarityIndex, compat: bool = False) -> DataFrame:
    """``id, uniqueness``: weighted mean distance to the three nearest rows over the largest such mean.

    ``compat`` uses neighbours 2 to 4, which is what one known implementation
    does.  Three rows or fewer all score 1.  Rows without a vector are not in
    the index and get no score.
    """
    if index.size() <= 3:
        return index.rows.select("id", F.lit(1.0).alias("uniqueness"))
    skip = 1 if compat else 0
    near = kneighbors(index, 3 + skip).where(F.col("rank") > skip)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("rank") - skip)
    score = near.groupBy(F.col("query_id").alias("id")).agg((F.sum(weight * F.col("dist")) / 3).alias("uniqueness"))
    return over_max(score, "uniqueness")


def cluster_distances(index: SimilarityIndex, clusters: DataFrame | None = None, k: int = 20, seed: int = 1234) -> DataFrame:
    """``id, cluster, dist``: Euclidean distance to the centre of the row's cluster.

    Clusters come from k-means unless ``clusters(id, cluster)`` gives them; a
    centre is the mean of its rows.
    """
    if clusters is None:
        data = index.rows.select("id", "embedding", array_to_vector("embedding").alias("features"))
        model = KMeans(k=min(k, index.size()), seed=seed, predictionCol="cluster").fit(data)
        rows = model.transform(data).select("id", "embedding", "cluster")
        centres = index.base.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    else:
        rows = index.rows.select("id", "embedding").join(clusters, "id")
        centres = rows.groupBy("cluster").agg(V.mean_of(F.col("embedding")).alias("centre"))
    return rows.join(centres, "cluster").select("id", "cluster", V.distance(F.col("embedding"), F.col("centre"), "euclidean").alias("dist"))


def representativeness(index: SimilarityIndex, *, clusters: DataFrame | None = None, k: int = 20, seed: int = 1234, downweight: bool = False, invert: bool = False, ball: float = 0.5) -> DataFrame:
    """``id, representativeness``: distance to the own cluster's centre over the cluster's largest.

    A centre scores 0 and an outlier 1; ``invert`` turns that round.
    ``downweight`` multiplies rows within ``ball`` (Euclidean) of a row of higher
    score by 0.7 and divides by the largest result.
    """
    d = cluster_distances(index, clusters, k, seed)
    tops = d.groupBy("cluster").agg(F.max("dist").alias("_top"))  # combined map-side; a window would put a cluster in one task
    score = F.coalesce(F.col("dist") / F.nullif(F.col("_top"), F.lit(0.0)), F.lit(0.0))
    out = d.join(tops, "cluster").select("id", F.round((1 - score) if invert else score, V.PLACES).alias("representativeness"))
    if not downweight:
        return out
    from curatrix.operators.neighbors import radius_neighbors

    plain = SimilarityIndex(index.base, index.view, "euclidean", center=False)
    edges = radius_neighbors(plain, ball)
    ends = edges.select(F.col("id_a").alias("id"), F.col("id_b").alias("o")).unionByName(edges.select(F.col("id_b").alias("id"), F.col("id_a").alias("o")))
    other = out.select(F.col("id").alias("o"), F.col("representativeness").alias("_o"))
    earlier = (F.col("_o") > F.col("representativeness")) | ((F.col("_o") == F.col("representativeness")) & (F.col("o") < F.col("id")))
    lower = ends.join(out, "id").join(other, "o").where(earlier).select("id").distinct().withColumn("_d", F.lit(0.7))
    weighed = out.join(lower, "id", "left").select("id", (F.col("representativeness") * F.coalesce("_d", F.lit(1.0))).alias("representativeness"))
    return over_max(weighed, "representativeness")


def hardness(logits: Column) -> Column:
    """Entropy of the softmax of logits; null without logits."""
    return V.entropy(V.softmax(logits))


def frame_max(df: DataFrame, sample: str, score: str) -> DataFrame:
    """A sample's score: the largest over its frames or objects."""
    return df.groupBy(sample).agg(F.max(score).alias(score))


def mistakenness(pred_label: Column, gt_label: Column, confidence: Column | None = None, logits: Column | None = None) -> Column:
    """Chance that a label is wrong: ``(m * c + 1) / 2`` with m = -1 where the prediction agrees, else 1.

    ``c`` is the confidence, or ``exp(-entropy)`` of the softmax of ``logits``.
    Without a prediction the score is 1; without a label too, it is null; a
    prediction without a label counts as agreeing.
    """
    c = confidence if logits is None else F.exp(-hardness(logits))
    m = F.when(gt_label.isNull() | (pred_label == gt_label), -1.0).otherwise(1.0)
    return F.when(pred_label.isNull() & gt_label.isNull(), F.lit(None).cast("double")).when(pred_label.isNull(), 1.0).otherwise((m * c + 1) / 2)


def label_set(labels: Column) -> Column:
    """Comparable form of a multilabel field: its distinct labels in order."""
    return F.array_sort(F.array_distinct(labels))


def centerness(dist: Column) -> Column:
    """1 at a centre, falling with the distance to it."""
    return 1 / (1 + dist)


def location_mistakenness(iou: Column, c: Column, limit: float = 0.5) -> Column:
    """Chance that a box is misplaced: ``(c * (2i - 1) + 1) / 2`` with i = (1 - iou) / (1 - limit)."""
    return (c * (2 * (1 - iou) / (1 - limit) - 1) + 1) / 2


def group_normalise(df: DataFrame, group: str, column: str) -> DataFrame:
    """``column`` over its largest value in the group; groups without positive values give 0.

    The largest values are aggregated map-side and joined back (a null group is
    a group of its own): a window would put a hot group in one task.
    """
    tops = df.groupBy(F.col(group).alias("_g")).agg(F.max(column).alias("_top"))
    joined = df.join(tops, F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(column, F.coalesce(F.col(column) / F.nullif(F.col("_top"), F.lit(0.0)), F.lit(0.0))).select(*df.columns)
