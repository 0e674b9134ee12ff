"""Session plumbing: shipping the package to executors and shared scratch tables.

Nothing here touches a machine-local folder on a cluster: intermediate tables go
to the folder named by ``spark.checkpoint.dir``.  Only a ``local[...]`` master
without that setting (tests, notebooks) falls back to a temporary folder.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local_scratch: dict[str, str] = {}


#: Bytes of an Arrow batch, where the session has Spark's default: a batch lies in the JVM and in the worker at once.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker of ``spark``, and keep batches small.

    Functions handed to ``mapInArrow`` are pickled by reference, so workers need
    the package.  It is zipped once per application and served by the driver.
    Batches to workers are bounded by ``BATCH_BYTES`` unless the session sets a
    bound of its own.
    """
    key, default, small = BATCH_BYTES
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, small)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="curatrix-"), "curatrix_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("curatrix", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` if it is set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = "file://" + tempfile.mkdtemp(prefix="curatrix-scratch-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch root."""
    return f"{scratch_root(spark)}/curatrix-{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a scratch table and read it back, which cuts its lineage.

    The table is a plain Parquet folder in shared storage, so it survives the
    loss of any executor (a local checkpoint would not).  It goes when the
    ``scratch_scope`` around the call ends, or by ``drop_scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _scopes:
        _scopes[-1].append(path)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete the scratch tables written inside, but for those written by the function that it gives.

    That function is ``materialize`` for results: their tables belong to the
    scope around this one, or to the caller.
    """
    _scopes.append([])
    kept: list[str] = []

    def result(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(_scopes[-1].pop())
        return out

    try:
        yield result
    finally:
        for path in _scopes.pop():
            _delete(spark, path)
        if _scopes:
            _scopes[-1] += kept


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(df: DataFrame) -> None:
    """Delete the scratch table behind a frame returned by ``materialize``."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/curatrix-" in folder:
            _delete(df.sparkSession, folder)
