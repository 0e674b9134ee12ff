"""MinHash near-duplicate detection by an inverted join over signature coordinates.

Plan
----
1. One Arrow pass turns each text into its set of word shingles and emits the
   set's size, a digest of the set and ``coordinates`` minima (the signature).
2. Texts with the same set collapse to one node: groups of exact copies, however
   large, cost one row from here on.
3. Every node is posted under each (coordinate, value) pair.  Lists that hold one
   node are dropped; the others are ordered from short to long.  Prefix merging:
   two signatures that collide in ``matches`` coordinates share one of the first
   ``coordinates - matches + 1`` lists of either, so only those are merged.  The
   longest lists of each node are skipped; their collisions are counted by
   probing, for nodes that have met.
4. Lists with the same smallest node are merged into one group, so nodes that
   meet in many lists meet once there, and their marks (a byte a coordinate) are
   shipped once.  Inside a group collisions are counted for the prefix first and
   then eight coordinates at a time; a pair is dropped as soon as the coordinates
   left can't bring it to ``matches``.  The graph of pairs that reach it is
   searched breadth first, and only a spanning forest leaves the task: rows stay
   linear in the postings although no pair is left out.
5. A group of more than ``list_rows`` rows is cut into blocks.  Each block is a
   task first; nodes that it has linked need no further comparison, so a group of
   copies is done then.  Only groups that still hold unlinked parts are compared
   across blocks, a task for each pair of blocks.
6. Components of the forest are candidate groups.  Texts of those nodes are read
   again and links are decided on the full sets (``100 * intersection >= percent
   * union``), in blocks by bytes and rows in the same two rounds.
7. Components of the confirmed links are mapped back to all copies.

``matches`` is the largest count for which a pair at exactly the threshold is
missed with a probability below ``miss`` (binomial tail); a mark's byte can only
add pairs to those that step 6 decides on.  Sets are held as 64-bit hashes of
shingles: two unlike sets of n shingles in all count a common one that they lack
with a probability of at most n**2 / 2**65 (1e-9 for two texts of 100,000 words).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curatrix.llm import kernels as K
from curatrix.llm import workers
from curatrix.llm.components import connected_components
from curatrix.session import materialize, scratch_scope, ship_package

MISS = 1e-8
#: Tables of more rows (some 60 bytes each) are not broadcast.
BROADCAST_ROWS = 200_000


def matches_needed(coordinates: int, percent: int, miss: float = MISS) -> int:
    """Agreeing coordinates that a pair at the threshold reaches but for ``miss``."""
    j, tail = percent / 100, 0.0
    for m in range(coordinates + 1):
        tail += math.comb(coordinates, m) * j**m * (1 - j) ** (coordinates - m)
        if tail > miss:
            return max(1, m)
    return coordinates


def _coefficients(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    x = K.mix64(base)
    return x[:coordinates], x[coordinates:] | np.uint64(1)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sign(classes: np.ndarray, shingle: int, coordinates: int) -> Callable:
    """Map (doc_id, text_hash, text) to (doc_id, text_hash, n, digest, keys, marks).

    ``keys`` has 40 bits for each coordinate after the coordinate's number, so
    that lists of unlike texts stay short up to some 10**12 texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, times = (c[:, None] for c in _coefficients(coordinates))
        number = np.arange(coordinates, dtype=np.uint64) << np.uint64(40)
        for batch in batches:
            for block in K.blocks(batch.column(2)):
                w = K.words(block, classes)
                h = K.word_hashes(block, w)
                sizes, digests, keys, marks = [], [], [], []
                for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True):
                    s = K.shingle_hashes(h[lo:hi], shingle)
                    sizes.append(len(s))
                    if not len(s):
                        for c in (digests, keys, marks):
                            c.append(None)
                        continue
                    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
                    for at in range(0, len(s), 2048):
                        np.minimum(least, ((s[None, at : at + 2048] ^ xor) * times).min(1), out=least)
                    least = K.mix64(least)
                    keys.append((number | least >> np.uint64(24)).astype("<u8").tobytes())
                    marks.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
                    digests.append(_digest(s))
                own = [batch.column(k).slice(block.first, len(sizes)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), *(pa.array(c, pa.binary()) for c in (digests, keys, marks))], ["doc_id", "text_hash", "n", "digest", "keys", "marks"])

    return run


def _post(coordinates: int) -> Callable:
    """Map (node, keys) to one row for each coordinate: (node, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), coordinates)), pa.array(keys)], ["node", "key"])

    return run


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading ``keys`` columns of rows that arrive sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = last is not None and first != last
        edge = np.flatnonzero(new)
        lo = 0
        for hi in [*edge.tolist(), batch.num_rows]:
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
            lo = hi
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _forest(nodes: np.ndarray, part: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Breadth-first forest over ``nodes``; ``near(i, rest)`` tells which of ``rest`` link with ``i``.

    Nodes of one ``part`` are known to be linked: they are not compared.
    """
    a, b = [], []
    rest = np.arange(len(nodes))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            known = part[rest] == part[i]
            if known.any():
                queue += rest[known].tolist()
                rest = rest[~known]
            if not len(rest):
                break
            hit = near(i, rest)
            for x in rest[hit].tolist():
                a.append(int(nodes[i]))
                b.append(int(nodes[x]))
                queue.append(x)
            rest = rest[~hit]
    return a, b


def _distinct(group: pa.Table, value: str) -> tuple[np.ndarray, np.ndarray, list]:
    """Nodes of a group, each once, with their parts and ``value``."""
    nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
    at = pa.array(first)
    return nodes, group.column("part").to_numpy()[first], group.column(value).take(at).to_pylist()


def _agree(coordinates: int, matches: int) -> Callable:
    """Map groups, sorted by (comp, bi, bj), to edges of a spanning forest of nodes with enough collisions."""
    prefix = coordinates - matches + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in _grouped(batches, 3):
            if group.num_rows < 2:
                continue
            nodes, part, marks = _distinct(group, "value")
            sig = np.frombuffer(b"".join(marks), np.uint8).reshape(-1, coordinates)

            def near(i: int, rest: np.ndarray, sig: np.ndarray = sig) -> np.ndarray:
                count = (sig[rest, :prefix] == sig[i, :prefix]).sum(1)
                out = np.zeros(len(rest), bool)
                alive = np.flatnonzero(count)  # without a collision in the prefix there are too few
                count = count[alive]
                for at in range(prefix, coordinates, 8):
                    can = count + (coordinates - at) >= matches
                    alive, count = alive[can], count[can]
                    count = count + (sig[rest[alive], at : at + 8] == sig[i, at : at + 8]).sum(1)
                out[alive[count >= matches]] = True
                return out

            x, y = _forest(nodes, part, near)
            a += x
            b += y
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _sets(classes: np.ndarray, shingle: int) -> Callable:
    """Map (comp, node, blocks, digest, text) to (comp, node, blocks, value): a node's set, once a task and only from its own text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in K.blocks(batch.column(4)):
                rows = len(block.bounds) - 1
                own = batch.slice(block.first, rows)
                w = K.words(block, classes)
                h = K.word_hashes(block, w)
                at, sets = [], []
                for k, (node, digest) in enumerate(zip(own.column(1).to_pylist(), own.column(3).to_pylist(), strict=True)):
                    if node in seen:
                        continue
                    s = K.shingle_hashes(h[w.bounds[k] : w.bounds[k + 1]], shingle)
                    if _digest(s) == digest:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(node)
                        at.append(k)
                        sets.append(s.tobytes())
                kept = own.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array(sets, pa.binary())], ["comp", "node", "blocks", "value"])

    return run


def _confirm(percent: int) -> Callable:
    """Map groups, sorted by (comp, bi, bj), to edges whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 3):
            if group.num_rows < 2:
                continue
            nodes, part, values = _distinct(group, "value")
            sets = [np.frombuffer(s, np.uint64) for s in values]
            size = np.array([len(s) for s in sets])
            edge = np.concatenate(([0], np.cumsum(size)))
            codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
            del sets, values
            # Inverted: the holders of each code in turn.
            holder = np.repeat(np.arange(len(nodes), dtype=np.int32), size)[np.argsort(codes, kind="stable")]
            ends = np.cumsum(np.bincount(codes))
            mark = np.zeros(len(ends), bool)
            n = len(nodes)

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                out = np.zeros(len(rest), bool)
                fit = 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
                few = rest[fit]
                if not len(few):
                    return out
                own = codes[edge[i] : edge[i + 1]]
                first = np.where(own > 0, ends[own - 1], 0)
                many = ends[own] - first
                if many.sum() <= size[few].sum():  # merge the lists of the own codes
                    at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                    both = np.bincount(holder[at], minlength=n)[few]
                else:  # probe the others' codes
                    many = size[few]
                    at = np.repeat(edge[few] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    mark[own] = True
                    both = np.add.reduceat(mark[codes[at]], np.cumsum(many) - many, dtype=np.int64)
                    mark[own] = False
                out[fit] = 100 * both >= percent * (size[few] + size[i] - both)
                return out

            x, y = _forest(nodes, part, near)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def _task(run: Callable) -> Callable:
    return workers.task("minhash", run, K.release)


def _linked(rows: DataFrame, kernel: Callable) -> DataFrame:
    """``(node, component)`` of the links that ``kernel`` finds within groups of ``rows(comp, node, blocks, value)``.

    ``blocks`` is a group's number of blocks.  Nodes that link with none are left
    out.  ``rows`` must be a written table.
    """

    def compared(df: DataFrame) -> DataFrame:
        dealt = df.select("comp", "bi", "bj", "node", "part", "value").repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "node")
        return dealt.mapInArrow(_task(kernel), "a long, b long")

    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks").cast("bigint")).cast("int")).otherwise(F.lit(0))
    rows = rows.withColumn("_own", block)
    alone = connected_components(compared(rows.withColumn("bi", F.col("_own")).withColumn("bj", F.col("_own")).withColumn("part", F.col("node"))))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return alone
    # Groups of several blocks whose nodes are not all linked yet: every pair of blocks.
    alone = materialize(alone, "linked")
    parts = large.join(alone.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").withColumn("part", F.coalesce("component", "node")).drop("_n", "component")
    split = parts.groupBy("comp").agg((F.min("part") < F.max("part")).alias("_s")).where("_s").select("comp")
    n = F.col("blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(F.least("_own", j).alias("bi"), F.greatest("_own", j).alias("bj")))
    across = parts.join(split, "comp", "left_semi").withColumn("_p", F.explode(F.filter(pairs, lambda p: p["bi"] != p["bj"])))
    more = compared(across.withColumn("bi", F.col("_p.bi")).withColumn("bj", F.col("_p.bj")))
    return connected_components(alone.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def _few(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _best(doc_id: str = "doc_id", text_hash: str = "text_hash") -> F.Column:
    """What the first document of a class is the least of: ids in order, none last."""
    return F.struct(F.col(doc_id).isNull().alias("_none"), F.col(doc_id).alias("doc_id"), F.col(text_hash).alias("text_hash"))


def _classed(docs: DataFrame, shingle: int, percent: int, classes: np.ndarray, coordinates: int, miss: float, list_rows: int, group_bytes: int) -> DataFrame:
    """``doc_id, text_hash, n, first``: a row for each of ``docs(doc_id, text_hash, text)``, and the first document that it links with (itself included; null for an empty set)."""
    need = matches_needed(coordinates, percent, miss)
    signed = materialize(docs.mapInArrow(_task(_sign(classes, shingle, coordinates)), "doc_id long, text_hash binary, n long, digest binary, keys binary, marks binary"), "signed")
    reps = signed.where("digest is not null").groupBy("digest").agg(F.min(_best()).alias("first"), *[F.first(c).alias(c) for c in ("n", "keys", "marks")])
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")

    posts = reps.select("node", "keys").mapInArrow(_task(_post(coordinates)), "node long, key long")
    lists = materialize(posts.groupBy("key").agg(F.count("*").alias("freq"), F.min("node").alias("comp")).where("freq > 1"), "lists")
    by_node = W.partitionBy("node")
    kept = (
        posts.join(lists, "key")
        .withColumn("shared", F.count("*").over(by_node))
        .withColumn("rank", F.row_number().over(by_node.orderBy("freq", "key")))
        .where(F.col("rank") <= F.col("shared") - need + 1)  # lists of one node count as the shortest
    )
    met = materialize(kept.groupBy("node", "comp").agg(F.count("*").alias("c")).join(reps.select("node", F.col("marks").alias("value")), "node"), "met")
    large = met.groupBy("comp").agg(F.count("*").alias("_f")).where(F.col("_f") > list_rows).select("comp", F.ceil(F.col("_f") / list_rows).alias("blocks"))
    groups = met.join(_few(materialize(large, "large")), "comp", "left").select("comp", "node", F.coalesce("blocks", F.lit(1)).alias("blocks"), "value")
    candidates = materialize(_linked(groups, _agree(coordinates, need)), "candidates")

    sized = candidates.join(reps.select("node", "n", "digest", "first"), "node").withColumnRenamed("component", "comp")
    plan = materialize(sized, "plan")
    totals = plan.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") * 8 / group_bytes), F.ceil(F.count("*") / list_rows)).alias("blocks"))
    wanted = materialize(plan.join(totals, "comp").select("comp", "node", "blocks", "digest", F.col("first.doc_id").alias("_d"), F.col("first.text_hash").alias("_h")), "wanted")
    text = docs.join(_few(wanted), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_h"))).select("comp", "node", "blocks", "digest", "text")
    full = materialize(text.mapInArrow(_task(_sets(classes, shingle)), "comp long, node long, blocks long, value binary"), "sets")
    linked = materialize(_linked(full, _confirm(percent)), "classes")

    firsts = linked.join(reps.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("first"))
    moved = linked.join(firsts, "component").select("node", F.col("first").alias("_f"))
    of_digest = reps.select("digest", "node", "first").join(moved, "node", "left").select("digest", F.coalesce("_f", "first").alias("first"))
    return signed.select("doc_id", "text_hash", "n", "digest").join(of_digest, "digest", "left").select("doc_id", "text_hash", "n", "first")


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("text_hash"), text.alias("text"))


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 5,
    percent: int = 80,
    classes: np.ndarray = K.ALNUM,
    coordinates: int = 64,
    miss: float = MISS,
    list_rows: int = 4096,
    group_bytes: int = 64 << 20,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` for
    their sets of ``shingle``-word shingles; a text of fewer words is one shingle.
    ``component_id`` is the smallest ``doc_id`` reachable over links and ``kept``
    marks that document.

    Every row is judged by its own text, so rows that repeat a ``doc_id`` with
    unlike texts may have different components, and repeated rows have the same
    one.  Null or empty texts, and those without words, have an empty set, link
    with nothing and are kept.  Rows without ``doc_id`` link like others; they
    have a null component, and are kept, where no document with an id is
    reachable.  An empty table gives no rows.  Other columns are ignored,
    whatever their names.  ``docs`` must give the same rows each time it is
    evaluated (it is read twice).
    """
    spark = docs.sparkSession
    ship_package(spark)
    with scratch_scope(spark) as result:
        found = _classed(_prepared(docs), shingle, percent, classes, coordinates, miss, list_rows, group_bytes)
        component = F.coalesce("first.doc_id", "doc_id")
        out = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))
        return result(out, "near")


def drop_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, classes: np.ndarray = K.ALNUM, coordinates: int = 64, miss: float = MISS, list_rows: int = 4096, group_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with one document of each group of linked ones: the smallest ``doc_id``, one without an id last.

    A document is a ``doc_id`` with a text: exact repeats stay once, unlike texts
    under one ``doc_id`` all count.  Rows with neither an id nor a text, and texts
    without words, are no duplicates of anything; of the latter, exact repeats go.
    All columns stay.  Only the documents that go, and those that are repeated, are
    joined with ``docs``, broadcast if they are few.  Tables written on the way to
    the result belong to the caller's ``scratch_scope``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    names = ["_doc", "_hash"]
    key = [F.col("doc_id").cast("long"), F.unhex(F.md5(F.col("text").cast("string").cast("binary")))]
    with scratch_scope(spark) as result:
        found = materialize(_classed(_prepared(docs), shingle, percent, classes, coordinates, miss, list_rows, group_bytes), "classed")
        own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & F.col("text_hash").eqNullSafe(F.col("first.text_hash"))
        gone = result(found.where(F.col("first").isNotNull() & ~own).select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct(), "gone")
        nothing = F.col("doc_id").isNull() & (F.col("n") == 0) & (F.col("text_hash").isNull() | (F.hex("text_hash") == F.upper(F.md5(F.lit(b"")))))
        twice = result(found.where(~nothing).groupBy(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "repeated")
    gone, repeated = gone.alias("g"), twice.isEmpty()

    def same(t: str) -> F.Column:
        return key[0].eqNullSafe(F.col(f"{t}._doc")) & key[1].eqNullSafe(F.col(f"{t}._hash"))

    kept = docs.join(_few(gone), same("g"), "left_anti")
    if repeated:
        return kept
    once = kept.join(_few(twice.alias("t")), same("t"), "left_anti")
    more = kept.join(_few(twice.alias("t")), same("t"), "left_semi")
    keyed = more.select("*", key[0].alias("_doc"), key[1].alias("_hash"))
    return once.unionByName(keyed.dropDuplicates(names).select(*docs.columns))
