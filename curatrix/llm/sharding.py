"""Byte-bounded shards by extendible hashing.

A row's hash is 32 bits of the MD5 of its key.  The directory is a binary trie
over hash prefixes: a bucket that exceeds the byte limit splits on its next bit,
all others stay as they are, until every shard fits.  The trie is derived from
one aggregate of bytes by fine prefix (rows combine map-side, so a hot key costs
one row), and only buckets that are still too large at that depth are looked at
with more bits.

Rows that agree in all 32 bits cannot be told apart by hashing; if such a bucket
is too large its rows are dealt into numbered chunks by running size, computed
over (bucket, input partition) so that a hot bucket is not one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curatrix.session import materialize

HASH_BITS = 32


def key_hash(key: F.Column) -> F.Column:
    """The first 32 bits of the key's MD5 as a long; null counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def _prefix(h: F.Column, depth: F.Column | int) -> F.Column:
    return F.floor(h / F.pow(F.lit(2.0), F.lit(HASH_BITS) - depth)).cast("long")


def _directory(sizes: DataFrame, depth: int, first: int, limit: int) -> DataFrame:
    """Leaves ``(depth, prefix, bytes)``: the shallowest prefixes of ``depth`` bits or fewer that fit.

    ``sizes(cell, bytes)`` are totals by prefix of ``depth`` bits.  Prefixes of
    ``depth`` bits that do not fit come out too, to be split further.
    """
    levels = F.explode(F.sequence(F.lit(first), F.lit(depth)))
    up = sizes.withColumn("depth", levels).withColumn("prefix", F.floor(F.col("cell") / F.pow(F.lit(2.0), F.lit(depth) - F.col("depth"))).cast("long"))
    totals = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"))
    full = totals.withColumn("fits", (F.col("bytes") <= limit) | (F.col("depth") == depth))
    # A fitting prefix is a leaf unless its parent fits as well; what fits at one level fits below.
    parent = full.where("fits").select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    return full.where("fits").join(parent, ["depth", "prefix"], "left_anti").select("depth", "prefix", "bytes")


def _chunked(rows: DataFrame, limit: int, own: Callable[[str], str]) -> DataFrame:
    """Number chunks of rows that share all hash bits, none over ``limit`` but single rows.

    Rows of half the limit or less are dealt by the half-limit step in which
    their running size starts, so a chunk holds at most one half plus one row;
    each larger row is a chunk of its own, numbered below zero.  The rows are
    written with the number of the task that wrote them and their place in it
    first: both are used twice and must be the same each time.
    """
    half = limit // 2
    place = ["shard_depth", "shard_prefix"]
    size, task, at = own("bytes"), own("task"), own("at")
    rows = materialize(rows.withColumn(task, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "crowded")
    big = F.col(size) > half
    local = W.partitionBy(*place, task).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    small, large, small_before, large_before = own("small"), own("large"), own("small_before"), own("large_before")
    running = rows.withColumn(small, F.coalesce(F.sum(F.when(~big, F.col(size))).over(local), F.lit(0))).withColumn(large, F.count(F.when(big, 1)).over(local))
    parts = rows.groupBy(*place, task).agg(F.sum(F.when(~big, F.col(size)).otherwise(0)).alias("s"), F.count(F.when(big, 1)).alias("l"))
    before = W.partitionBy(*place).orderBy(task).rowsBetween(W.unboundedPreceding, -1)  # a row a task
    offsets = parts.select(*place, task, F.coalesce(F.sum("s").over(before), F.lit(0)).alias(small_before), F.coalesce(F.sum("l").over(before), F.lit(0)).alias(large_before))
    chunk = F.when(big, -1 - F.col(large_before) - F.col(large)).otherwise(F.floor((F.col(small_before) + F.col(small)) / F.lit(half)))
    out = running.join(offsets, [*place, task]).withColumn("shard_chunk", chunk.cast("int"))
    sums = out.groupBy(*place, "shard_chunk").agg(F.sum(size).alias("shard_bytes"))
    return out.drop("shard_bytes", task, at, small, large, small_before, large_before).join(sums, [*place, "shard_chunk"])


def _own_names(columns: list[str]) -> Callable[[str], str]:
    """Names for working columns that no column of ``columns`` has, in any case."""
    start = "_shard"
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return lambda name: f"{start}{name}"


def shard(docs: DataFrame, *, key: str = "doc_id", size: F.Column | None = None, limit: int = 16 << 20, fine_bits: int | None = None) -> DataFrame:
    """Columns of ``docs`` with ``shard_depth int, shard_prefix long, shard_chunk int, shard_bytes long``.

    A shard is (depth, prefix, chunk).  ``size`` gives a row's bytes, the UTF-8
    length of ``text`` by default; null texts have size 0.  No shard exceeds
    ``limit`` unless it is one single row that does.  Rows with equal or null
    keys share a hash; rows that tie in all bits are dealt into chunks, repeated
    rows each on their own.  An empty table gives no rows.  Columns named like
    the results are replaced; any other name is allowed.
    """
    size = F.coalesce((F.octet_length("text") if size is None else size).cast("long"), F.lit(0))
    columns = [c for c in docs.columns if c not in ("shard_depth", "shard_prefix", "shard_chunk", "shard_bytes")]
    own = _own_names(columns)
    hashed, taken, cell, deep = own("hash"), own("bytes"), own("cell"), own("deep")
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], key_hash(F.col(key)).alias(hashed), size.alias(taken))
    total = rows.agg(F.sum(taken)).first()[0] or 0
    bits = fine_bits or min(HASH_BITS, max(1, total // limit).bit_length() + 6)

    # Level by level: leaves of the directory, then what is still too large with eight more bits.
    levels: list[tuple[int, DataFrame, DataFrame]] = []
    todo, first = rows.select(hashed, taken), 0
    while True:
        cells = todo.groupBy(_prefix(F.col(hashed), bits).alias("cell")).agg(F.sum(taken).alias("bytes"))
        found = materialize(_directory(cells, bits, first, limit), "directory")
        over = found.where((F.col("depth") == bits) & (F.col("bytes") > limit)) if bits < HASH_BITS else found.limit(0)
        deeper = not over.isEmpty()
        levels.append((bits, found, over.select(F.col("prefix").alias(deep))))
        if not deeper:
            break
        todo = todo.join(levels[-1][2], _prefix(F.col(hashed), bits) == F.col(deep), "left_semi")
        first, bits = bits + 1, min(HASH_BITS, bits + 8)

    # The directory proper: every prefix of a level's depth points to its leaf, and one equi-join routes the rows.
    parts, rest = [], rows
    for depth, found, over in levels:
        spread = F.pow(F.lit(2.0), F.lit(depth) - F.col("depth")).cast("long")
        cells = F.explode(F.sequence(F.col("prefix") * spread, (F.col("prefix") + 1) * spread - 1)).alias(cell)
        leaves = found.select(cells, F.col("depth").alias("shard_depth"), F.col("prefix").alias("shard_prefix"), F.col("bytes").alias("shard_bytes"))
        last = depth == levels[-1][0]
        here = leaves if last else leaves.join(over, leaves[cell] == over[deep], "left_anti")
        parts.append(rest.join(here, _prefix(rest[hashed], depth) == here[cell]).drop(cell))
        if not last:
            rest = rest.join(over, _prefix(rest[hashed], depth) == over[deep], "left_semi")
    routed = parts[0]
    for p in parts[1:]:
        routed = routed.unionByName(p)
    routed = routed.withColumn("shard_depth", F.col("shard_depth").cast("int"))
    crowded = (F.col("shard_depth") == HASH_BITS) & (F.col("shard_bytes") > limit)
    if levels[-1][0] == HASH_BITS and not levels[-1][1].where((F.col("depth") == HASH_BITS) & (F.col("bytes") > limit)).isEmpty():
        out = routed.where(~crowded).withColumn("shard_chunk", F.lit(0)).unionByName(_chunked(routed.where(crowded), limit, own))
    else:
        out = routed.withColumn("shard_chunk", F.lit(0))
    return out.select(*[F.col(f"`{c}`") for c in columns], "shard_depth", "shard_prefix", "shard_chunk", "shard_bytes")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the rows of each shard to a folder of its own below ``path``."""
    out = shard(docs, **options)
    place = ["shard_depth", "shard_prefix", "shard_chunk"]
    out.repartition(*place).drop("shard_bytes").write.partitionBy(*place).parquet(path)
