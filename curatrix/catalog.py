"""Registered queries over the test tables, with SQL that gives the same rows.

``embeddings`` serves as samples with vectors, ``orders`` with ``lineitem`` as
samples with nested labels, ``documents`` for contents, ``events`` for values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix import analysis as A
from curatrix.functions import boxes
from curatrix.functions import ids as I
from curatrix.functions import vectors as V
from curatrix.operators import duplicates as D
from curatrix.operators import neighbors as N
from curatrix.operators import objects as O
from curatrix.operators import scores as S
from curatrix.operators import visualization as Z
from curatrix.operators.index import SimilarityIndex, build_index, clear_field, ordered_distinct, select_ordered, write_field
from curatrix.plans.profiles import PROFILES
from curatrix.sources import embeddings as E
from curatrix.streaming.maintain import tumbling_counts

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

DUP = 0.62  # the test vectors are nearly isotropic: no pair is nearer than 0.4

#: CTEs shared by the SQL: vectors, their mean, centred vectors.
E_ = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
C_ = f"""{E_},
m AS (SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e) GROUP BY i),
mu AS (SELECT list(m ORDER BY i) AS mu FROM m),
c AS (SELECT id, list_transform(list_zip(v, mu), lambda z: z[1] - z[2]) AS v FROM e, mu)"""
PAIRS_ = f"{C_}, p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_distance(a.v, b.v), 9) AS d FROM c a JOIN c b ON a.id <> b.id)"
EDGES_ = f"{C_}, g AS (SELECT a.id AS a, b.id AS b, round(list_cosine_distance(a.v, b.v), 9) AS d FROM c a JOIN c b ON a.id < b.id WHERE round(list_cosine_distance(a.v, b.v), 9) <= {DUP})"
#: The greedy pass in index order, row by row.
DUPS_ = f"""{EDGES_},
earlier AS (SELECT b AS id, list(a) AS nb FROM g GROUP BY b),
r AS (SELECT row_number() OVER (ORDER BY id) AS k, id, coalesce(nb, []) AS nb FROM e LEFT JOIN earlier USING (id)),
w(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT r.k, CASE WHEN list_has_any(w.kept, r.nb) THEN w.kept ELSE list_append(w.kept, r.id) END FROM w JOIN r ON r.k = w.k + 1),
kept AS (SELECT unnest(kept) AS id FROM (SELECT kept FROM w ORDER BY k DESC LIMIT 1)),
ends AS (SELECT a AS id, b AS o, d FROM g UNION ALL SELECT b, a, d FROM g),
near AS (SELECT id, arg_min(o, (d, o)) AS nearest_id, min(d) AS dist FROM ends WHERE o IN (SELECT id FROM kept) AND id NOT IN (SELECT id FROM kept) GROUP BY id),
dups AS (SELECT e.id, CASE WHEN n.nearest_id IS NOT NULL THEN 'duplicate' WHEN e.id IN (SELECT nearest_id FROM near) THEN 'nearest' ELSE 'unique' END AS type, n.nearest_id, n.dist FROM e LEFT JOIN near n USING (id))"""
SPLITS_ = "s AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM embeddings)"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _index(spark: SparkSession, d: str, **options) -> SimilarityIndex:
    return build_index(_t(spark, d, "embeddings"), "vec_id", "embedding", **options)


def _splits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id") % 10
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(k < 7, "train").when(k < 9, "val").otherwise("test").alias("split"))


def _range(spark: SparkSession, lo: int, hi: int) -> DataFrame:
    return spark.range(lo, hi).select("id")


def _top(expr: str, k: int = 10, desc: bool = False, ctes: str = C_, source: str = "c", where: str = "") -> str:
    order = f"dist {'DESC' if desc else ''} NULLS LAST, id"
    return f"WITH {ctes}, d AS (SELECT {source}.id, {expr} AS dist FROM {source} {where}) SELECT id, row_number() OVER (ORDER BY {order})::INTEGER AS rank, dist FROM d ORDER BY {order} LIMIT {k}"


# Similarity search ---------------------------------------------------------


@register(_top("CASE WHEN c.id = 0 THEN 0.0 ELSE round(list_cosine_distance(c.v, q.v), 9) END", where=", (SELECT v FROM c WHERE id = 0) q"))
def sim_topk_by_id(spark, d):
    return N.sort_by_similarity(_index(spark, d), [0], k=10)


@register(_top("CASE WHEN c.id = 0 THEN 0.0 ELSE round(list_cosine_distance(c.v, q.v), 9) END", desc=True, where=", (SELECT v FROM c WHERE id = 0) q"))
def sim_least_similar(spark, d):
    return N.sort_by_similarity(_index(spark, d), [0], k=10, reverse=True)


_UP = "[" + ", ".join(f"{(i % 7) - 3}::DOUBLE" for i in range(64)) + "]"


@register(_top(f"round(list_cosine_distance(e.v, {_UP}), 9)", ctes=E_, source="e"))
def sim_topk_by_vector(spark, d):
    return N.sort_by_similarity(_index(spark, d), vectors=[[(i % 7) - 3.0 for i in range(64)]], k=10)


@register(_top("round(list_cosine_distance(e.v, q.v), 9)", ctes=f"{E_}, u AS (SELECT i, avg(x) AS m FROM (SELECT generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e WHERE id IN (1, 2, 3)) GROUP BY i)", source="e", where=", (SELECT list(m ORDER BY i) AS v FROM u) q"))
def sim_multi_query_mean(spark, d):
    return N.sort_by_similarity(_index(spark, d), [1, 2, 3], k=10)


def _post(name: str, agg: str) -> None:
    sql = _top("x.dist", ctes=f"{C_}, x AS (SELECT a.id, round({agg}(round(list_cosine_distance(a.v, b.v), 9)), 9) AS dist FROM c a, c b WHERE b.id IN (1, 2, 3) AND a.id <> b.id GROUP BY a.id)", source="x")

    def query(spark, d):
        return N.sort_by_similarity(_index(spark, d), [1, 2, 3], k=10, aggregation=f"post-{name}")

    query.__name__ = f"sim_multi_query_post_{name}"
    register(sql)(query)


for _name, _agg in (("min", "min"), ("max", "max"), ("mean", "avg")):
    _post(_name, _agg)

_DISTANCES = {
    "euclidean": "list_distance({a}, {b})",
    "dotproduct": "-list_inner_product({a}, {b})",
    "l1": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
    "innerproduct": "-list_inner_product({a}, {b})",
    "hamming": "list_sum(list_transform(list_zip({a}, {b}), lambda z: CASE WHEN z[1] <> z[2] THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))",
}


def _metric(metric: str, expr: str) -> None:
    sql = _top(f"round({expr.format(a='e.v', b='q.v')}, 9)::DOUBLE", ctes=E_, source="e", where=", (SELECT v FROM e WHERE id = 5) q")

    def query(spark, d):
        i = _index(spark, d, metric=metric, center=False)
        asked = [list(r[0]) for r in i.rows.where("id = 5").select("embedding").collect()]
        return N.sort_by_similarity(i, vectors=asked, k=10)

    query.__name__ = f"sim_{metric}"
    register(sql)(query)


for _name, _agg in _DISTANCES.items():
    _metric(_name, _agg)


_BITS = "list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > 0.1 THEN 1.0 ELSE 0.0 END)"


@register(f"WITH e AS (SELECT vec_id AS id, {_BITS} AS v FROM embeddings), d AS (SELECT e.id, round(CASE WHEN list_max(e.v) + list_max(q.v) = 0 THEN 0.0 ELSE 1 - list_inner_product(e.v, q.v) / (list_sum(e.v) + list_sum(q.v) - list_inner_product(e.v, q.v)) END, 9)::DOUBLE AS dist FROM e, (SELECT v FROM e WHERE id = 5) q) SELECT id, row_number() OVER (ORDER BY dist, id)::INTEGER AS rank, dist FROM d ORDER BY dist, id LIMIT 10")
def sim_jaccard(spark, d):
    """Vectors as sets of the dimensions over 0.1."""
    bits = F.transform(V.vector("embedding"), lambda x: F.when(x > 0.1, 1.0).otherwise(0.0))
    i = build_index(_t(spark, d, "embeddings").withColumn("embedding", bits), "vec_id", "embedding", metric="jaccard", center=False)
    asked = [list(r[0]) for r in i.rows.where("id = 5").select("embedding").collect()]
    return N.sort_by_similarity(i, vectors=asked, k=10)


@register(_top("CASE WHEN c.id = 3 THEN 0.0 ELSE round(list_cosine_distance(c.v, q.v), 9) END", where=", (SELECT v FROM c WHERE id = 3) q WHERE c.id BETWEEN 100 AND 299"))
def sim_in_view(spark, d):
    """The query lies outside the view; distances are centred by the whole index."""
    return N.sort_by_similarity(_index(spark, d).restrict(_range(spark, 100, 300)), [3], k=10)


@register(f"WITH {PAIRS_} SELECT a AS query_id, row_number() OVER (PARTITION BY a ORDER BY d, b)::INTEGER AS rank, b AS id, d AS dist FROM p QUALIFY rank <= 4")
def knn_all_pairs_k4(spark, d):
    return N.kneighbors(_index(spark, d), 4)


@register(f"WITH {PAIRS_} SELECT a AS query_id, 1::INTEGER AS rank, arg_min(b, (d, b)) AS id, min(d) AS dist FROM p WHERE a % 50 = 0 GROUP BY a")
def knn_query_subset_k1(spark, d):
    """Nearest neighbours of a stated set of queries against all rows."""
    i = _index(spark, d)
    return N.kneighbors(i, 1, i.centred().where("id % 50 = 0"))


@register(f"WITH {EDGES_} SELECT a AS id_a, b AS id_b, d AS dist FROM g")
def radius_edges(spark, d):
    return N.radius_neighbors(_index(spark, d), DUP)


@register(f"WITH {PAIRS_}, n AS (SELECT a, min(d) AS d FROM p GROUP BY a), z AS (SELECT min(d) AS lo, (max(d) - min(d)) / 100 AS w FROM n) SELECT least(floor((d - lo) / w), 99)::INTEGER AS bin, count(*) AS n FROM n, z GROUP BY bin")
def nn_distance_histogram(spark, d):
    return N.nearest_histogram(_index(spark, d), 100)


@register(_top("round(-list_inner_product(e.v, q.v), 9)", k=20, ctes=E_, source="e", where=", (SELECT v FROM e WHERE id = 5) q"))
def backend_profile_topk(spark, d):
    """A store profile's default metric decides the order."""
    profile = PROFILES["milvus"]
    i = _index(spark, d, metric=profile.check(None, 20, False, lambda: 20)[0], center=False)
    asked = [list(r[0]) for r in i.rows.where("id = 5").select("embedding").collect()]
    return N.sort_by_similarity(i, vectors=asked, k=20, profile=profile.name)


# Duplicates and leaks -------------------------------------------------------


@register(f"WITH RECURSIVE {DUPS_} SELECT * FROM dups")
def near_duplicates(spark, d):
    return D.find_duplicates(_index(spark, d), DUP)


@register(f"WITH RECURSIVE {DUPS_} SELECT coalesce(nearest_id, id) AS nearest_id, id, type, coalesce(dist, 0.0) AS dist FROM dups WHERE type <> 'unique'")
def duplicates_view(spark, d):
    return D.duplicates_view(D.find_duplicates(_index(spark, d), DUP))


@register(f"WITH RECURSIVE {DUPS_} SELECT id FROM dups WHERE type <> 'duplicate'")
def unique_view(spark, d):
    return D.find_duplicates(_index(spark, d), DUP).where("type <> 'duplicate'").select("id")


@register()
def unique_subset(spark, d):
    """100 rows of the whole index, as far apart as a bisected threshold makes them."""
    return D.find_unique(_index(spark, d), 100)[0]


@register()
def unique_half(spark, d):
    """Half of the rows of the whole index, as far apart as a bisected threshold makes them."""
    i = _index(spark, d)
    return D.find_unique(i, i.size() // 2)[0]


@register("WITH h AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS f FROM documents WHERE text IS NOT NULL) SELECT f AS first_id, doc_id AS dup_id FROM h WHERE f <> doc_id")
def exact_duplicates(spark, d):
    return D.exact_duplicates(_t(spark, d, "documents"), "doc_id", "text")


@register(f"WITH RECURSIVE {DUPS_}, {SPLITS_} SELECT d.id, s.split, d.nearest_id, t.split AS nearest_split, d.dist FROM dups d JOIN s ON d.id = s.id JOIN s t ON d.nearest_id = t.id WHERE d.type = 'duplicate' AND s.split <> t.split")
def leaky_splits(spark, d):
    return D.leaky_splits(D.find_duplicates(_index(spark, d), DUP), _splits(spark, d))


_LEAKS = f"WITH RECURSIVE {DUPS_}, {SPLITS_}, l AS (SELECT d.id, d.nearest_id FROM dups d JOIN s ON d.id = s.id JOIN s t ON d.nearest_id = t.id WHERE d.type = 'duplicate' AND s.split <> t.split)"


@register(f"{_LEAKS} SELECT id, split FROM s WHERE id NOT IN (SELECT id FROM l)")
def no_leaks_view(spark, d):
    splits = _splits(spark, d)
    return D.no_leaks(splits, leaky_splits(spark, d))


@register(f"{_LEAKS} SELECT id, CASE WHEN id IN (SELECT id FROM l UNION SELECT nearest_id FROM l) THEN split || ',leak' ELSE split END AS tags FROM s")
def tag_leaks(spark, d):
    tagged = _splits(spark, d).select("id", F.array("split").alias("tags"))
    return D.tag_leaks(tagged, leaky_splits(spark, d)).select("id", F.array_join("tags", ",").alias("tags"))


@register(f"{_LEAKS}, q AS (SELECT max(nearest_id) AS id FROM l) SELECT d.id FROM dups d JOIN s ON d.id = s.id, q JOIN s t ON t.id = q.id WHERE d.nearest_id = q.id AND s.split <> t.split")
def leaks_for_sample(spark, d):
    dups, splits = D.find_duplicates(_index(spark, d), DUP), _splits(spark, d)
    sample = D.leaky_splits(dups, splits).agg(F.max("nearest_id")).first()[0]
    return D.leaks_for(dups, splits, sample)


@register("WITH t AS (SELECT vec_id AS id, unnest(CASE WHEN vec_id % 2 = 0 AND vec_id % 3 = 0 THEN ['three', 'two'] WHEN vec_id % 2 = 0 THEN ['two'] WHEN vec_id % 3 = 0 THEN ['three'] ELSE [] END) AS split FROM embeddings) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM t a JOIN t b ON a.id = b.id AND a.split < b.split GROUP BY 1, 2")
def split_overlaps(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("vec_id") % 3 == 0, "three"), F.when(F.col("vec_id") % 2 == 0, "two")))
    return D.split_overlaps(_t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.explode(tags).alias("split")))


@register("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'three' WHEN vec_id % 2 = 0 THEN 'two' END AS split FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0")
def split_last_wins(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    two, three = (e.where(F.col("id") % k == 0).select("id", F.lit(n).alias("split"), F.lit(p).alias("split_pos")) for k, n, p in ((2, "two", 0), (3, "three", 1)))
    return D.split_of(two.unionByName(three))


# Scores -------------------------------------------------------------------------


def _unique_sql(skip: int) -> str:
    return f"WITH {PAIRS_}, k AS (SELECT a AS id, d, row_number() OVER (PARTITION BY a ORDER BY d, b) - {skip} AS r FROM p QUALIFY r BETWEEN 1 AND 3), u AS (SELECT id, (0.6::DOUBLE * max(d) FILTER (r = 1) + 0.3::DOUBLE * max(d) FILTER (r = 2) + 0.1::DOUBLE * max(d) FILTER (r = 3)) / 3 AS u FROM k GROUP BY id) SELECT id, round(u / max(u) OVER (), 9) AS uniqueness FROM u"


@register(_unique_sql(0))
def uniqueness_3nn(spark, d):
    return S.uniqueness(_index(spark, d)).withColumn("uniqueness", F.round("uniqueness", 9))


@register(_unique_sql(1))
def uniqueness_compat(spark, d):
    return S.uniqueness(_index(spark, d), compat=True).withColumn("uniqueness", F.round("uniqueness", 9))


_CENTRES = "x AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), z AS (SELECT label, list(m ORDER BY i) AS z FROM (SELECT label, i, avg(x) AS m FROM x GROUP BY label, i) GROUP BY label), d AS (SELECT vec_id AS id, label, round(list_distance(embedding::DOUBLE[], z), 9) AS d FROM embeddings JOIN z USING (label)), s AS (SELECT id, round(d / max(d) OVER (PARTITION BY label), 9) AS s FROM d)"


def _clusters(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


@register(f"WITH {_CENTRES} SELECT id, s AS representativeness FROM s")
def representativeness_label_centroid(spark, d):
    return S.representativeness(_index(spark, d), clusters=_clusters(spark, d))


@register(f"WITH {E_}, {_CENTRES}, b AS (SELECT DISTINCT p.id FROM s p JOIN s q ON q.s > p.s OR (q.s = p.s AND q.id < p.id) JOIN e a ON a.id = p.id JOIN e b ON b.id = q.id WHERE round(list_distance(a.v, b.v), 9) <= 1.0), w AS (SELECT id, s * CASE WHEN id IN (SELECT id FROM b) THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s) SELECT id, round(w / max(w) OVER (), 9) AS representativeness FROM w")
def representativeness_downweight(spark, d):
    out = S.representativeness(_index(spark, d), clusters=_clusters(spark, d), downweight=True, ball=1.0)
    return out.withColumn("representativeness", F.round("representativeness", 9))


@register()
def representativeness_kmeans(spark, d):
    return S.representativeness(_index(spark, d))


_LOGITS = "l AS (SELECT vec_id AS id, label, list_transform(embedding[1:10]::DOUBLE[], lambda x: x * 10) AS l FROM embeddings), p AS (SELECT id, label, l, list_transform(l, lambda x: exp(x - list_max(l))) AS w FROM l), q AS (SELECT id, label, list_position(l, list_max(l)) - 1 AS pred, list_transform(w, lambda x: x / list_sum(w)) AS p FROM p), h AS (SELECT id, label, pred, p, -list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0.0 END)) AS h FROM q)"


def _predicted(spark, d) -> DataFrame:
    logits = F.transform(F.slice(V.vector("embedding"), 1, 10), lambda x: x * 10)
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), logits.alias("logits"))
    return rows.withColumn("pred", (F.array_position("logits", F.array_max("logits")) - 1).cast("int"))


@register(f"WITH {_LOGITS} SELECT id, round(h, 6) AS hardness FROM h")
def hardness(spark, d):
    return _predicted(spark, d).select("id", F.round(S.hardness(F.col("logits")), 6).alias("hardness"))


@register(f"WITH {_LOGITS} SELECT id // 10 AS sample_id, round(max(h), 6) AS hardness FROM h GROUP BY 1")
def hardness_video(spark, d):
    """Ten rows in a row are a video's frames."""
    rows = _predicted(spark, d).select(F.floor(F.col("id") / 10).cast("long").alias("sample_id"), F.round(S.hardness(F.col("logits")), 6).alias("hardness"))
    return S.frame_max(rows, "sample_id", "hardness")


@register(f"WITH {_LOGITS} SELECT id, round((CASE WHEN pred = label THEN -1 ELSE 1 END * exp(-h) + 1) / 2, 6) AS mistakenness FROM h")
def mistakenness_logits(spark, d):
    rows = _predicted(spark, d)
    return rows.select("id", F.round(S.mistakenness(F.col("pred"), F.col("label"), logits=F.col("logits")), 6).alias("mistakenness"))


@register(f"WITH {_LOGITS}, n AS (SELECT id, CASE WHEN id % 11 = 0 THEN NULL ELSE pred END AS pred, CASE WHEN id % 7 = 0 THEN NULL ELSE label END AS label, list_max(p) AS conf FROM h) SELECT id, round(CASE WHEN pred IS NULL AND label IS NULL THEN NULL WHEN pred IS NULL THEN 1.0 ELSE (CASE WHEN label IS NULL OR pred = label THEN -1 ELSE 1 END * conf + 1) / 2 END, 6) AS mistakenness FROM n")
def mistakenness_conf(spark, d):
    rows = _predicted(spark, d)
    pred, label = F.when(F.col("id") % 11 != 0, F.col("pred")), F.when(F.col("id") % 7 != 0, F.col("label"))
    return rows.select("id", F.round(S.mistakenness(pred, label, F.array_max(V.softmax(F.col("logits")))), 6).alias("mistakenness"))


@register("SELECT vec_id AS id, CASE WHEN list_sort(list_distinct([label, vec_id % 3])) = list_sort(list_distinct([vec_id % 3, vec_id % 5])) THEN 0.25 ELSE 0.75 END::DOUBLE AS mistakenness FROM embeddings")
def mistakenness_multilabel(spark, d):
    i = F.col("vec_id")
    pred, gt = S.label_set(F.array(F.col("label").cast("long"), i % 3)), S.label_set(F.array(i % 3, i % 5))
    return _t(spark, d, "embeddings").select(i.alias("id"), S.mistakenness(pred, gt, F.lit(0.5)).alias("mistakenness"))


# Index maintenance, views and fields ----------------------------------------------


def _new(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").where("vec_id < 50").select((F.col("vec_id") + F.when(F.col("vec_id") % 2 == 0, 0).otherwise(1_000_000)).alias("id"), F.transform(V.vector("embedding"), lambda x: x * 2).alias("embedding"))


def _upsert_sql(first: str, second: str) -> str:
    return f"WITH {E_}, n AS (SELECT vec_id + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 1000000 END AS id, list_transform(embedding::DOUBLE[], lambda x: x * 2) AS v FROM embeddings WHERE vec_id < 50) SELECT coalesce(e.id, n.id) AS id, round(list_sum(coalesce({first}.v, {second}.v)), 9) AS total FROM e FULL JOIN n ON e.id = n.id"


def _total():
    return F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 9).alias("total")



@register(_upsert_sql("n", "e"))
def index_upsert(spark, d):
    return _index(spark, d).add(_new(spark, d)).rows.select("id", _total())


@register(_upsert_sql("e", "n"))
def index_insert_only(spark, d):
    return _index(spark, d).add(_new(spark, d), overwrite=False).rows.select("id", _total())


@register("SELECT vec_id AS id FROM embeddings WHERE vec_id NOT BETWEEN 100 AND 149")
def index_remove(spark, d):
    return _index(spark, d).remove(_range(spark, 100, 150)).rows.select("id")


@register("SELECT vec_id AS id, (300 - vec_id)::BIGINT AS request_pos FROM embeddings WHERE vec_id BETWEEN 201 AND 300")
def index_get(spark, d):
    ask = spark.range(201, 301).select("id", (300 - F.col("id")).alias("pos"))
    return _index(spark, d).get(ask).select("id", "request_pos")


@register("SELECT r AS id FROM range(400, 2500) t(r) WHERE r NOT IN (SELECT vec_id FROM embeddings)")
def index_missing(spark, d):
    return _index(spark, d).missing(_range(spark, 400, 2500))


@register("SELECT vec_id AS id, (1000 - vec_id)::BIGINT AS pos FROM embeddings WHERE vec_id % 3 = 0")
def view_filter_ids(spark, d):
    view = _t(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (1000 - F.col("vec_id")).alias("rank"))
    return _index(spark, d).restrict(view, order="rank").rows.select("id", "pos")


@register("SELECT doc_id, source, n FROM (SELECT doc_id, source, (doc_id * 7919) % 1000 AS n FROM documents) WHERE n < 100")
def select_ordered_ids(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    ids = docs.select(F.col("doc_id").alias("id"), ((F.col("doc_id") * 7919) % 1000).alias("pos")).where("pos < 100")
    return select_ordered(docs, ids, "doc_id").withColumnRenamed("request_pos", "n")


@register("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer")
def score_write_back(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return write_field(c, c.where("c_custkey % 4 = 0").select("c_custkey", F.lit(1.0).alias("c_acctbal")), "c_acctbal", "c_custkey")


@register("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END::DOUBLE AS c_acctbal FROM customer")
def field_clear(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return clear_field(c, c.where("c_custkey % 4 = 0"), "c_acctbal", "c_custkey")


@register("SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 9) AS total FROM embeddings WHERE vec_id % 5 <> 0")
def embedding_scan(spark, d):
    """Rows without a vector are left out at the source."""
    rows = _t(spark, d, "embeddings").withColumn("emb", F.when(F.col("vec_id") % 5 != 0, F.col("embedding")))
    return E.from_field(rows, "vec_id", "emb").select("id", _total())


@register("SELECT vec_id AS id, len(embedding)::INTEGER AS n, round(list_sum(embedding::DOUBLE[]), 9) AS total FROM embeddings")
def vector_text_parse(spark, d):
    """Vectors spelled as text and read again."""
    text = F.concat(F.lit("["), F.array_join(F.transform(V.vector("embedding"), lambda x: x.cast("string")), ", "), F.lit("]"))
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), V.parse_vector(text).alias("embedding"))
    return rows.select("id", F.size("embedding").alias("n"), _total())


@register("WITH h AS (SELECT o_orderkey, substr(md5(o_orderkey::VARCHAR), 1, 24) AS h FROM orders) SELECT o_orderkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 4) || '00000000' AS uuid, h AS back FROM h")
def id_to_uuid(spark, d):
    h = F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 24)
    rows = _t(spark, d, "orders").select("o_orderkey", I.to_uuid(h).alias("uuid"))
    return rows.withColumn("back", I.from_uuid(F.col("uuid")))


@register("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_hash(spark, d):
    raw = F.col("text").cast("binary")
    return _t(spark, d, "documents").select("doc_id", F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"))


@register("SELECT event_id, event_type, value * 2 + 1 AS expr FROM events")
def value_projection(spark, d):
    return _t(spark, d, "events").select("event_id", "event_type", (F.col("value") * 2 + 1).alias("expr"))


@register("SELECT doc_id, lang, round(n_chars::DOUBLE / max(n_chars) OVER (PARTITION BY lang), 9) AS n_chars FROM documents")
def group_normalise(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("n_chars"))
    return S.group_normalise(docs, "lang", "n_chars").withColumn("n_chars", F.round("n_chars", 9))


@register("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return tumbling_counts(_t(spark, d, "events"))


# Nested labels and objects ------------------------------------------------------------


def _orders(spark, d) -> DataFrame:
    item = F.struct(F.col("l_linenumber").alias("id"), F.col("l_quantity").cast("double").alias("confidence"), F.col("l_returnflag").alias("label"))
    lists = _t(spark, d, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("labels"))
    return _t(spark, d, "orders").select("o_orderkey").join(lists, "o_orderkey", "left").withColumnRenamed("o_orderkey", "sample_id")


_ITEMS = "i AS (SELECT l_orderkey AS sample_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag) - 1)::INTEGER AS idx, l_linenumber AS id, l_quantity::DOUBLE AS confidence, l_returnflag AS label FROM lineitem WHERE l_quantity > 25 AND l_orderkey IN (SELECT o_orderkey FROM orders))"


@register(f"WITH {_ITEMS} SELECT * FROM i")
def patches_flatten(spark, d):
    return O.flatten_labels(_orders(spark, d), "labels")


@register(f"WITH {_ITEMS} SELECT o_orderkey AS sample_id, idx, id, confidence, label FROM orders LEFT JOIN i ON o_orderkey = sample_id")
def patches_handle_missing(spark, d):
    return O.flatten_labels(_orders(spark, d), "labels", handle_missing="image")


@register(f"WITH {_ITEMS} SELECT sample_id, count(*) FILTER (label = 'R')::INTEGER AS n FROM i GROUP BY 1 HAVING count(*) FILTER (label = 'R') > 0")
def labels_filter(spark, d):
    return O.filter_labels(_orders(spark, d), "labels", lambda x: x["label"] == "R").select("sample_id", F.size("labels").alias("n"))


@register("WITH x AS (SELECT vec_id // 4 AS sample_id, generate_subscripts(embedding, 1) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT sample_id, i, avg(x) AS m FROM x GROUP BY 1, 2) SELECT sample_id, round(max(m), 9) AS top, count(*)::INTEGER AS n FROM m GROUP BY 1")
def roi_mean(spark, d):
    """Four rows in a row are the regions of one sample."""
    rows = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("sample_id"), "embedding")
    return O.pool(rows).select("sample_id", F.round(F.array_max("embedding"), 9).alias("top"), F.size("embedding").alias("n"))


_BOX_SQL = """l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_orderkey AS sample_id, l_linenumber AS id, l_returnflag AS label, l_linenumber / 10.0::DOUBLE AS x, 0.08::DOUBLE AS w FROM l),
p AS (SELECT l_orderkey AS sample_id, l_linenumber AS id, CASE WHEN l_partkey % 5 = 0 THEN 'X' ELSE l_returnflag END AS label, l_linenumber / 10.0::DOUBLE + (l_suppkey % 8) / 100.0::DOUBLE AS x, 0.08::DOUBLE AS w, (l_partkey % 100) / 100.0::DOUBLE AS c FROM l),
pairs AS (SELECT g.sample_id, g.id, g.label, p.label AS plabel, p.c, round(greatest(least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x), 0) * 0.5::DOUBLE / (0.08::DOUBLE * 0.5 + 0.08::DOUBLE * 0.5 - greatest(least(g.x + g.w, p.x + p.w) - greatest(g.x, p.x), 0) * 0.5::DOUBLE), 9) AS iou FROM g JOIN p ON g.sample_id = p.sample_id AND g.id = p.id)"""


def _boxes(spark, d) -> tuple[DataFrame, DataFrame]:
    """Boxes of an order stand apart, so a prediction overlaps at most the box that it was shifted from by half."""
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_returnflag", "l_partkey", "l_suppkey")])
    x = F.col("l_linenumber") / 10.0

    def box(left):
        return F.array(left, F.lit(0.2), F.lit(0.08), F.lit(0.5))

    gt = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("label"), box(x).alias("bounding_box"), F.lit(1.0).alias("confidence"))
    label = F.when(F.col("l_partkey") % 5 == 0, "X").otherwise(F.col("l_returnflag"))
    pred = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("id"), label.alias("label"), box(x + (F.col("l_suppkey") % 8) / 100.0).alias("bounding_box"), ((F.col("l_partkey") % 100) / 100.0).alias("confidence"))
    return gt, pred


@register(f"WITH {_BOX_SQL} SELECT sample_id, id AS gt_id, id AS pred_id, iou FROM pairs WHERE iou >= 0.5")
def object_match(spark, d):
    return O.match_boxes(*_boxes(spark, d))


@register(f"""WITH {_BOX_SQL},
m AS (SELECT *, iou >= 0.5 AS hit FROM pairs)
SELECT sample_id, id, 'gt' AS side, CASE WHEN hit THEN round((CASE WHEN label = plabel THEN -1 ELSE 1 END * c + 1) / 2, 9) END AS mistakenness,
  CASE WHEN hit THEN round((c * (2 * (1 - iou) / 0.5 - 1) + 1) / 2, 8) END AS mistakenness_loc, NOT hit AS possible_spurious, false AS possible_missing FROM m
UNION ALL SELECT sample_id, id, 'pred', NULL, NULL, false, true FROM m WHERE NOT hit AND c > 0.95""")
def object_mistakenness(spark, d):
    out = O.object_mistakenness(*_boxes(spark, d))
    return out.withColumn("mistakenness", F.round("mistakenness", 9)).withColumn("mistakenness_loc", F.round("mistakenness_loc", 8))


@register(f"""WITH {_BOX_SQL}, m AS (SELECT *, iou >= 0.5 AS hit FROM pairs)
SELECT sample_id, round(coalesce(max(CASE WHEN hit THEN (CASE WHEN label = plabel THEN -1 ELSE 1 END * c + 1) / 2 END), -1), 9)::DOUBLE AS mistakenness,
  count(*) FILTER (NOT hit AND c > 0.95) AS n_missing, count(*) FILTER (NOT hit) AS n_spurious FROM m GROUP BY sample_id""")
def sample_mistakenness(spark, d):
    gt, pred = _boxes(spark, d)
    samples = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id")).distinct()
    out = O.sample_mistakenness(samples, O.object_mistakenness(gt, pred))
    return out.withColumn("mistakenness", F.round("mistakenness", 9))


@register(f"WITH {_BOX_SQL}, m AS (SELECT *, iou >= 0.5 AS hit FROM pairs) SELECT sample_id, count(*) + count(*) FILTER (NOT hit AND c > 0.95) AS n FROM m GROUP BY sample_id")
def copy_missing(spark, d):
    gt, pred = _boxes(spark, d)
    return O.with_missing(gt, pred, O.object_mistakenness(gt, pred)).groupBy("sample_id").agg(F.count("*").alias("n"))


_BOX = {"x": "l_linenumber / 10.0::DOUBLE", "y": "l_discount::DOUBLE", "w": "l_quantity::DOUBLE / 100", "h": "(l_tax::DOUBLE + 0.01)"}


@register("WITH b AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{e} AS {n}" for n, e in _BOX.items()) + " FROM lineitem) SELECT l_orderkey, l_linenumber, round(x - w * 0.25, 9) AS x, round(w * 1.5, 9) AS w, round(y + (h - greatest(w, h)) / 2, 9) AS square_y, round(greatest(w, h), 9) AS side FROM b")
def box_shapes(spark, d):
    box = F.array(F.col("l_linenumber") / 10.0, F.col("l_discount").cast("double"), F.col("l_quantity").cast("double") / 100, F.col("l_tax").cast("double") + 0.01)
    wide, sq = boxes.expand(box, 0.5), boxes.square(box)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.get(wide, 0), 9).alias("x"), F.round(F.get(wide, 2), 9).alias("w"), F.round(F.get(sq, 1), 9).alias("square_y"), F.round(F.get(sq, 2), 9).alias("side"))


# Projections -----------------------------------------------------------------------------


@register()
def pca_projection(spark, d):
    return Z.pca(_index(spark, d)).points.select("id", F.get("point", 0).alias("x"), F.get("point", 1).alias("y"))


@register()
def pca_incremental(spark, d):
    """Fitted on half of the rows, extended by the rest."""
    i = _index(spark, d)
    half = Z.pca(i.restrict(i.rows.where("id % 2 = 0")))
    return half.add(i.rows.select("id", "embedding")).points.select("id", F.get("point", 0).alias("x"))


@register()
def tsne_projection(spark, d):
    return Z.visualize(_index(spark, d), "tsne", max_iters=300).points.select("id", F.get("point", 0).alias("x"), F.get("point", 1).alias("y"))


@register()
def umap_projection(spark, d):
    """A neighbour layout of the whole index."""
    return Z.visualize(_index(spark, d), "umap").points.select("id", F.get("point", 0).alias("x"), F.get("point", 1).alias("y"))


@register()
def umap_incremental(spark, d):
    """A neighbour layout of half of the rows, extended by the rest."""
    i = _index(spark, d)
    half = Z.visualize(i.restrict(i.rows.where("id % 2 = 0")), "umap")
    return half.add(i.rows.select("id", "embedding")).points.select("id", F.get("point", 0).alias("x"), F.get("point", 1).alias("y"))


_PTS = "p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT least(min(x), min(y)) AS lo, greatest(max(x), max(y)) AS hi FROM p)"


def _points(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 2).alias("point"))


@register(f"WITH {_PTS} SELECT id, x, y FROM p")
def manual_points(spark, d):
    return Z.manual(_points(spark, d)).points.select("id", F.get("point", 0).alias("x"), F.get("point", 1).alias("y"))


@register(f"WITH {_PTS} SELECT id, least(floor((x - lo) / (hi - lo) * 64), 63)::INTEGER AS cell_x, least(floor((y - lo) / (hi - lo) * 64), 63)::INTEGER AS cell_y FROM p, b")
def grid_index(spark, d):
    return Z.grid(Z.manual(_points(spark, d)).points).drop("point")


@register("SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 1")
def new_ids(spark, d):
    p = Z.manual(_points(spark, d).where("id % 2 = 0"))
    return p.new_ids(_points(spark, d))


@register(f"WITH RECURSIVE {DUPS_} SELECT type, count(*) AS n FROM dups GROUP BY type")
def point_types(spark, d):
    types = Z.point_types(Z.manual(_points(spark, d)), D.find_duplicates(_index(spark, d), DUP))
    return types.groupBy("type").agg(F.count("*").alias("n"))


# Ids as text, appended rows, stores' rules ----------------------------------------------

_TEXT_DUPS = DUPS_.replace(E_, E_.replace("vec_id AS id", "vec_id::VARCHAR AS id")).replace("BIGINT[]", "VARCHAR[]")


@register(f"WITH RECURSIVE {_TEXT_DUPS} SELECT * FROM dups")
def near_duplicates_string_ids(spark, d):
    """Text ids: rows stand in the order of their ids."""
    return D.find_duplicates(build_index(_t(spark, d, "embeddings").withColumn("vec_id", F.col("vec_id").cast("string")), "vec_id", "embedding"), DUP)


@register("SELECT vec_id AS id, vec_id AS pos FROM embeddings UNION ALL SELECT vec_id + 1000000, (SELECT max(vec_id) + 1 FROM embeddings) FROM embeddings WHERE vec_id < 50 AND vec_id % 2 = 1")
def index_append_order(spark, d):
    """New rows stand after all others."""
    return _index(spark, d).add(_new(spark, d)).rows.select("id", "pos")


_FROM_0 = ("CASE WHEN c.id = 0 THEN 0.0 ELSE round(list_cosine_distance(c.v, q.v), 9) END", ", (SELECT v FROM c WHERE id = 0) q")


@register(_top(_FROM_0[0], k=10_000, where=_FROM_0[1]))
def profile_capped_k(spark, d):
    """A store that returns its largest number of rows when none is asked for."""
    return N.sort_by_similarity(_index(spark, d), [0], profile="mongodb")


@register(f"WITH top AS ({_top(_FROM_0[0], k=60, where=_FROM_0[1])}) SELECT id, row_number() OVER (ORDER BY dist, id)::INTEGER AS rank, dist FROM top WHERE id BETWEEN 100 AND 299")
def profile_post_filter(spark, d):
    """A store that filters by the view after the search."""
    return N.sort_by_similarity(_index(spark, d).restrict(_range(spark, 100, 300)), [0], k=60, profile="mosaic")


@register(_top(_FROM_0[0], k=1_000_000_000, where=_FROM_0[1]))
def sim_all_ranked(spark, d):
    """All rows with their ranks."""
    return N.sort_by_similarity(_index(spark, d), [0])


@register(f"WITH {EDGES_} SELECT a AS id_a, b AS id_b, d AS dist FROM g")
def radius_edges_cells(spark, d):
    """The same pairs by cells, of which pairs too far apart are skipped."""
    return N.radius_neighbors(_index(spark, d), DUP, cells=16)


@register(f"WITH RECURSIVE {DUPS_} SELECT nearest_id, count(*) AS n, min(dist) AS least, arg_min(id, (dist, id)) AS first_id FROM dups WHERE type = 'duplicate' GROUP BY nearest_id")
def duplicate_groups(spark, d):
    groups = D.duplicate_groups(D.find_duplicates(_index(spark, d), DUP))
    return groups.select("nearest_id", "n", "least", F.get("duplicates", 0)["id"].alias("first_id"))


@register("SELECT vec_id AS id, label * 2 AS value FROM embeddings WHERE vec_id % 3 = 0")
def index_values(spark, d):
    view = _t(spark, d, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"))
    return _index(spark, d).use_view(view).values(_t(spark, d, "embeddings"), F.col("label") * 2, id_col="vec_id")


@register("SELECT doc_id AS id, lang AS split, (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS split_pos FROM documents WHERE lang IS NOT NULL")
def splits_by_field(spark, d):
    return D.splits_by(_t(spark, d, "documents"), "lang", id_col="doc_id")


@register("SELECT vec_id AS id, 'three' AS split, 0::INTEGER AS split_pos FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 'two', 1 FROM embeddings WHERE vec_id % 2 = 0")
def splits_by_tags(spark, d):
    tags = F.array_compact(F.array(F.when(F.col("vec_id") % 2 == 0, "two"), F.when(F.col("vec_id") % 3 == 0, "three"), F.lit("all")))
    return D.splits_by(_t(spark, d, "embeddings").withColumn("tags", tags), ["three", "two"], id_col="vec_id")


@register(f"WITH {_CENTRES} SELECT id, round(1 / (1 + d), 9) AS centerness FROM d")
def centerness(spark, d):
    dist = S.cluster_distances(_index(spark, d), _clusters(spark, d))
    return dist.select("id", F.round(S.centerness(F.col("dist")), 9).alias("centerness"))


@register("SELECT l_suppkey AS id, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1")
def ids_in_first_order(spark, d):
    return ordered_distinct(_t(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")))


# Label lists --------------------------------------------------------------------------------


def _labelled(spark, d) -> DataFrame:
    """Orders with their lines as labels, whose ids are unique."""
    rows = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("label"), F.min("l_quantity").cast("double").alias("confidence"))
    item = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "label", "confidence")
    return rows.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.array_sort(F.collect_list(item)).alias("labels"))


_LABELLED = "l AS (SELECT l_orderkey AS sample_id, l_linenumber AS n, l_orderkey * 10 + l_linenumber AS id, min(l_returnflag) AS label, min(l_quantity)::DOUBLE AS confidence FROM lineitem GROUP BY 1, 2)"


@register(f"WITH {_LABELLED} SELECT sample_id, id, CASE WHEN n % 2 = 0 THEN n::DOUBLE END AS score FROM l")
def label_field_write(spark, d):
    """A new field of labels, set for some of them."""
    samples = _labelled(spark, d)
    some = O.flatten_labels(samples, "labels").where("id % 2 = 0").select(F.col("id").alias("label_id"), (F.col("id") % 10).cast("double").alias("score"))
    return O.flatten_labels(O.write_label_field(samples, "labels", some, "score"), "labels").select("sample_id", "id", "score")


@register(f"WITH {_LABELLED} SELECT sample_id, id, CASE WHEN n <> 1 THEN confidence END AS confidence FROM l")
def label_field_clear(spark, d):
    samples = _labelled(spark, d)
    first = O.flatten_labels(samples, "labels").where("id % 10 = 1").select(F.col("id").alias("label_id"))
    return O.flatten_labels(O.clear_label_field(samples, "labels", first, "confidence"), "labels").select("sample_id", "id", "confidence")


@register(f"WITH {_LABELLED} SELECT id AS label_id, sample_id FROM l WHERE n = 2")
def label_owners(spark, d):
    samples = _labelled(spark, d)
    wanted = O.flatten_labels(samples, "labels").where("id % 10 = 2").select(F.col("id").alias("label_id"))
    return O.label_owners(samples, "labels", wanted.unionByName(wanted.select((-F.col("label_id")).alias("label_id"))))


@register(f"WITH {_LABELLED} SELECT sample_id, min(id * 7919 % 100003) AS rank FROM l WHERE label = 'R' GROUP BY 1")
def samples_by_first_label(spark, d):
    flat = O.flatten_labels(_labelled(spark, d), "labels")
    ranks = flat.where("label = 'R'").select("id", (F.col("id") * 7919 % 100003).alias("rank"))
    return O.samples_by_first_label(ranks, flat.select(F.col("id").alias("label_id"), "sample_id"))


@register(f"WITH {_LABELLED} SELECT o_orderkey AS sample_id, (o_orderkey % 97)::BIGINT AS pos, id FROM orders LEFT JOIN (SELECT sample_id, id FROM l WHERE label = 'R') ON o_orderkey = sample_id")
def labels_of_reference(spark, d):
    """Labels in the order of given samples; samples without any stay."""
    flat = O.flatten_labels(_labelled(spark, d), "labels").where("label = 'R'").select("sample_id", "id")
    return O.labels_of(_t(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 97).alias("pos")), flat)


# The public calls ------------------------------------------------------------------------------


class _TextModel:
    """Length and number of a's; prompts are embedded like contents."""

    def __call__(self, texts: list) -> list:
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    def embed_prompts(self, prompts: list[str]) -> list:
        return self(prompts)


_TEXTS = "e AS (SELECT doc_id AS id, [length(text)::DOUBLE, (length(text) - length(replace(text, 'a', '')))::DOUBLE] AS v FROM documents WHERE text IS NOT NULL)"


@register(_top(_FROM_0[0], where=_FROM_0[1]))
def api_similarity(spark, d):
    """A field's vectors to an index to the rows nearest to an id."""
    return A.compute_similarity(_t(spark, d, "embeddings"), id_col="vec_id", embeddings="embedding").sort_by_similarity(0, k=10)


@register(_top("round(list_distance(e.v, [400.0::DOUBLE, 20.0::DOUBLE]), 9)", ctes=_TEXTS, source="e"))
def api_model_index(spark, d):
    """Vectors by a model, queried by a vector."""
    index = A.compute_similarity(_t(spark, d, "documents"), id_col="doc_id", model=_TextModel, content="text", metric="euclidean")
    return index.sort_by_similarity([400.0, 20.0], k=10)


@register(_top("round(list_distance(e.v, [24.0::DOUBLE, 2.0::DOUBLE]), 9)", ctes=_TEXTS, source="e"))
def api_prompt_query(spark, d):
    index = A.compute_similarity(_t(spark, d, "documents"), id_col="doc_id", model=_TextModel, content="text", metric="euclidean")
    return index.sort_by_similarity("a prompt of many letters", k=10)


@register(f"WITH {_TEXTS} SELECT id, list_sum(v) AS total FROM e WHERE id % 2 = 1")
def api_compute_embeddings(spark, d):
    """Vectors of the rows that an index lacks, by its own model."""
    docs = _t(spark, d, "documents")
    index = A.compute_similarity(docs.where("doc_id % 2 = 0"), id_col="doc_id", model=_TextModel, content="text", metric="euclidean")
    return index.compute_embeddings(docs, id_col="doc_id", skip_existing=True).select("id", _total())


@register(f"WITH {_LABELLED}, v AS (SELECT sample_id, avg(confidence) AS x, avg(n::DOUBLE) AS y FROM l GROUP BY 1) SELECT sample_id AS id, round(x, 9) AS x, round(y, 9) AS y FROM v")
def api_region_pooling(spark, d):
    """Samples by the mean of their regions' vectors."""
    samples = _labelled(spark, d).withColumn("labels", F.transform("labels", lambda l: F.struct(l["id"].alias("id"), F.array(l["confidence"], (l["id"] % 10).cast("double")).alias("embedding"))))
    index = A.compute_similarity(samples, id_col="sample_id", embeddings="labels.embedding", regions="labels")
    return index.index.rows.select("id", F.round(F.get("embedding", 0), 9).alias("x"), F.round(F.get("embedding", 1), 9).alias("y"))


@register(f"WITH RECURSIVE {DUPS_}, s AS (SELECT vec_id AS id, label::VARCHAR AS split FROM embeddings) SELECT d.id, s.split, d.nearest_id, t.split AS nearest_split, d.dist FROM dups d JOIN s ON d.id = s.id JOIN s t ON d.nearest_id = t.id WHERE d.type = 'duplicate' AND s.split <> t.split")
def api_leaky_splits(spark, d):
    """Leaks between the values of a field."""
    return A.compute_leaky_splits(_t(spark, d, "embeddings"), "label", DUP, id_col="vec_id", embeddings="embedding", warn=False)[2]


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
