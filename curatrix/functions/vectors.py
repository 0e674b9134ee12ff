"""Vector arithmetic on ``array<double>`` columns, inside the JVM.

Distances are rounded to nine decimals before anything is ranked by them, so
that ties are ties on every engine and are broken by id.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 9
METRICS = ("cosine", "euclidean", "dotproduct", "innerproduct", "l1", "jaccard", "hamming")


def vector(c: Column | str) -> Column:
    """Any numeric array as ``array<double>``: float arithmetic would differ between engines."""
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def unit(a: Column) -> Column:
    """``a`` at length 1; the zero vector gives null."""
    return F.transform(a, lambda x: x / F.nullif(norm(a), F.lit(0.0)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Distance, smaller is closer, for every metric (dot products are negated)."""
    if metric == "cosine":
        d = 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    elif metric == "euclidean":
        d = F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    elif metric in ("dotproduct", "innerproduct"):
        d = -dot(a, b)
    elif metric == "l1":
        d = _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    elif metric == "hamming":
        d = _total(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
    elif metric == "jaccard":
        either = _total(F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)))
        unlike = _total(F.zip_with(a, b, lambda x, y: F.when((x != 0) != (y != 0), 1.0).otherwise(0.0)))
        d = F.when(either == 0, 0.0).otherwise(unlike / either)
    else:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return F.round(d, PLACES)


def mean_of(column: Column) -> Column:
    """Aggregate: the mean of the vectors of a group, combined map-side as one vector; null ones are left out."""
    return vector_to_array(Summarizer.mean(array_to_vector(column)))


def mean_vector(df: DataFrame, column: str = "embedding") -> list[float] | None:
    """Mean over rows, as long as one vector; the driver gets one row."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    got = rows.agg(F.when(F.count("*") > 0, F.lit(True)).alias("any"), mean_of(F.col("_v")).alias("m")) if not rows.isEmpty() else None
    return list(got.first().m) if got is not None else None


def softmax(logits: Column) -> Column:
    """Exponentials over their sum; the largest logit and the sum are taken once a row."""
    top = F.transform(F.array(logits), lambda l: F.struct(l.alias("l"), F.array_max(l).alias("m")))
    e = F.transform(top, lambda t: F.transform(t["l"], lambda x: F.exp(x - t["m"])))
    sums = F.transform(e, lambda v: F.struct(v.alias("v"), _total(v).alias("s")))
    return F.get(F.transform(sums, lambda t: F.transform(t["v"], lambda x: x / t["s"])), 0)


def entropy(p: Column) -> Column:
    """Shannon entropy in nats; zero terms count as zero."""
    return -_total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def parse_vector(text: Column) -> Column:
    """``"[1,2]"`` as a vector; null if it isn't one."""
    return F.from_json(text, "array<double>")


def euclidean_threshold(cosine: float) -> float:
    """The Euclidean distance of unit vectors at a cosine distance."""
    if cosine < 0:
        raise ValueError("a cosine distance isn't negative")
    return (2 * cosine) ** 0.5
