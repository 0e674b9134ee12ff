"""Joins whose left side may have hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of the left rows, so there are fewer hot keys than that.
SHARE = 1000
#: Tasks that a hot key's rows are dealt to.
COPIES = 256


def join_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with ``right``, which has one row for each ``key``; null keys find nothing.

    Rows of hot keys are dealt to ``COPIES`` tasks by a hash of the whole row
    with its place in its partition, and the right rows of those keys, fewer than
    ``SHARE``, are copied to all of them.  ``left`` is read twice.
    """
    total = left.where(F.col(key).isNotNull()).count()
    hot = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > max(total / SHARE, COPIES)).select(key, F.lit(True).alias("_hot"))
    hot = hot.sparkSession.createDataFrame(hot.collect(), hot.schema)  # fewer than SHARE rows
    salt = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)).cast("int")).otherwise(F.lit(0))
    salted = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    spread = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")
