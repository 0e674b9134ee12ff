"""Contracts of the library: errors, odd rows, views, sources, settings, runs and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import boxes, ids
from curatrix.functions import vectors as V
from curatrix.operators import duplicates as D
from curatrix.operators import neighbors as N
from curatrix.operators import objects as O
from curatrix.operators import scores as S
from curatrix.operators import visualization as Z
from curatrix.operators.index import build_index, select_ordered
from curatrix.plans import settings
from curatrix.plans.profiles import PROFILES, register
from curatrix.plans.runs import Runs
from curatrix.sources import embeddings as E
from curatrix.streaming.maintain import compact_index, current_index, maintain_index, tumbling_counts


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(51).normal(size=(60, 8)).round(3)


@pytest.fixture(scope="module")
def index(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(60, None), (None, [0.0] * 8)]
    return build_index(spark.createDataFrame(rows, "id long, emb array<double>"), "id", "emb")


def cosine(vectors):
    x = vectors - vectors.mean(0)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = (1 - x @ x.T).round(9)
    np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("block", [2048, 7])
def test_neighbours_by_brute_force(index, vectors, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    d = cosine(vectors)
    got = {(r.query_id, r.rank): r.id for r in N.kneighbors(index, 3).collect()}
    want = {(i, k + 1): j for i in range(60) for k, j in enumerate(sorted(range(60), key=lambda j: (d[i, j], j))[:3])}
    assert got == want
    pairs = {(r.id_a, r.id_b) for r in N.radius_neighbors(index, 0.7).collect()}
    assert pairs == {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 0.7}


@pytest.mark.parametrize("block", [2048, 9])
def test_cells_with_all_probes_are_exact(index, block, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", block)
    got = N.kneighbors_cells(index, 3, cells=6, probes=6).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, N.kneighbors(index, 3).collect()))
    empty = index.restrict(index.rows.where("id < 0"))
    assert N.kneighbors_cells(empty, 3).count() == 0
    with pytest.raises(ValueError):
        N.kneighbors_cells(index, 3, probes=0)


def test_recall_of_cells(spark):
    """The test vectors are nearly isotropic, the hardest case for cells."""
    i = build_index(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    want = {(r.query_id, r.id) for r in N.kneighbors(i, 10).collect()}
    got = {(r.query_id, r.id) for r in N.kneighbors_cells(i, 10).collect()}
    recall = len(want & got) / len(want)
    print(f"recall {recall:.4f}")
    assert recall >= 0.9


def test_greedy_duplicates_by_brute_force(index, vectors):
    d = cosine(vectors)
    kept = []
    for i in range(60):
        if all(d[i, j] > 0.7 for j in kept):
            kept.append(i)
    rows = {r.id: r for r in D.find_duplicates(index, 0.7).collect()}
    assert sorted(i for i, r in rows.items() if r.type != "duplicate") == kept
    for i, r in rows.items():
        if r.type == "duplicate":
            assert r.nearest_id == min(kept, key=lambda j: (d[i, j], j))
    chosen, thresh = D.find_unique(index, 20)
    assert chosen.count() == 20 and thresh > 0
    assert D.find_unique(index, 0)[1] is None and D.find_unique(index, 100)[0].count() == 60
    assert D.find_duplicates_fraction(index, 2.0)[1] is None


def test_query_arguments(index):
    with pytest.raises(ValueError, match="not in the index"):
        N.sort_by_similarity(index, [999])
    with pytest.raises(ValueError, match="ids or vectors"):
        N.sort_by_similarity(index)
    with pytest.raises(ValueError, match="aggregation"):
        N.sort_by_similarity(index, [1], aggregation="median")
    for profile, k, reverse in (("pinecone", None, False), ("pinecone", 10_001, False), ("qdrant", 5, True)):
        with pytest.raises(ValueError):
            N.sort_by_similarity(index, [1], k=k, reverse=reverse, profile=profile)
    first = N.sort_by_similarity(index, [7], k=1).first()
    assert (first.id, first.rank, first.dist) == (7, 1, 0.0)
    with pytest.raises(ValueError):
        N.kneighbors(index, 0)


def test_index_changes(spark, index):
    new = spark.createDataFrame([(5, [1.0] * 8), (100, [2.0] * 8), (100, [3.0] * 8), (101, None), (None, [1.0] * 8)], "id long, embedding array<double>").coalesce(1)
    added = index.add(new)
    assert added.size() == 61
    at = {r.id: r.embedding[0] for r in added.rows.where("id in (5, 100)").collect()}
    assert at == {5: 1.0, 100: 3.0}
    assert index.add(new, overwrite=False).rows.where("id = 5").first().embedding[0] != 1.0
    with pytest.raises(ValueError):
        index.add(new, allow_existing=False)
    gone = spark.createDataFrame([(5,), (999,)], "id long")
    assert index.remove(gone).size() == 59
    with pytest.raises(ValueError):
        index.remove(gone, allow_missing=False)
    with pytest.raises(ValueError):
        index.get(gone, allow_missing=False)
    view = index.restrict(gone)
    assert (view.size(), view.clear().size(), [r.id for r in index.missing(gone).collect()]) == (1, 60, [999])


def test_order_follows_the_request(spark):
    df = spark.createDataFrame([(i, f"f{i}") for i in range(5)], "id long, path string")
    ask = spark.createDataFrame([(3, 0), (1, 1), (3, 2), (9, 3)], "id long, pos long")
    assert [r.id for r in select_ordered(df, ask).collect()] == [3, 1, 3]


def test_scores(spark, index):
    u = S.uniqueness(index).toPandas()
    assert len(u) == 60 and u.uniqueness.between(0, 1).all() and u.uniqueness.max() == 1
    three = index.restrict(spark.range(3).toDF("id"))
    assert {r.uniqueness for r in S.uniqueness(three).collect()} == {1.0}
    one = spark.createDataFrame([([0.0, 0.0],), ([100.0, 0.0],), (None,)], "l array<double>").select(S.hardness(F.col("l")).alias("h")).collect()
    assert [None if r.h is None else round(r.h, 9) for r in one] == [round(math.log(2), 9), 0.0, None]
    groups = spark.createDataFrame([(None, 2.0), (None, 4.0), ("a", 0.0), ("b", None)], "g string, x double")
    assert sorted(map(str, (r.x for r in S.group_normalise(groups, "g", "x").collect()))) == ["0.0", "0.0", "0.5", "1.0"]


def test_boxes(spark):
    row = spark.createDataFrame([([0.0, 0.0, 0.2, 0.1], [0.1, 0.0, 0.2, 0.1], [0.5, 0.5, 0.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    r = row.select(boxes.iou(F.col("a"), F.col("b")).alias("x"), boxes.iou(F.col("c"), F.col("c")).alias("y"), boxes.square(F.col("a")).alias("s"), boxes.expand(F.col("a"), 1.0).alias("e")).first()
    assert (round(r.x, 9), r.y) == (round(1 / 3, 9), 0.0)
    assert np.allclose(r.s, [0, -0.05, 0.2, 0.2]) and np.allclose(r.e, [-0.1, -0.05, 0.4, 0.2])


def test_matching_is_one_to_one(spark):
    rng = random.Random(9)
    gt = [(s, i, [rng.random() * 0.2, 0.0, 0.5, 0.5]) for s in range(20) for i in range(4)]
    pred = [(s, i, [rng.random() * 0.2, 0.0, 0.5, 0.5], rng.choice([0.5, 0.9, None])) for s in range(20) for i in range(5)]
    m = O.match_boxes(spark.createDataFrame(gt, "sample_id long, id long, bounding_box array<double>"), spark.createDataFrame(pred, "sample_id long, id long, bounding_box array<double>, confidence double")).collect()
    got = {(r.sample_id, r.gt_id, r.pred_id) for r in m}

    def iou(a, b):
        w = min(a[0], b[0]) + 0.5 - max(a[0], b[0])
        return round(w * 0.5 / (0.5 - w * 0.5), 9)

    want = set()
    for s in range(20):
        free = {i: b for t, i, b in gt if t == s}
        for _, i, b, _ in sorted((p for p in pred if p[0] == s), key=lambda p: (-p[3] if p[3] is not None else math.inf, p[1])):
            fits = sorted((-iou(g, b), j) for j, g in free.items() if iou(g, b) >= 0.5)
            if fits:
                want.add((s, fits[0][1], i))
                del free[fits[0][1]]
    assert got == want


def test_labels(spark):
    kind = "sample_id long, labels array<struct<id:long,label:string>>"
    df = spark.createDataFrame([(1, [(10, "a"), (11, "b")]), (2, []), (3, None)], kind)
    assert O.flatten_labels(df, "labels").count() == 2
    assert O.flatten_labels(df, "labels", handle_missing="image").count() == 4
    with pytest.raises(ValueError):
        O.flatten_labels(df, "labels", handle_missing="error")
    back = O.nest_labels(O.flatten_labels(df, "labels")).collect()
    assert [(r.sample_id, [x.id for x in r.labels]) for r in back] == [(1, [10, 11])]


def test_layouts_place_rows_beyond_the_sample(index):
    for method, updates in (("umap", True), ("tsne", False)):
        whole = Z.visualize(index, method, max_iters=30, fit_rows=None)
        assert whole.points.count() == 60 == whole.trained_on
        p = Z.visualize(index, method, max_iters=30, fit_rows=25)
        assert p.points.count() == 60 and p.trained_on == 25 and p.supports_updates == updates
        assert p.points.where("size(point) <> 2").count() == 0
    with pytest.raises(ValueError):
        p.add(index.rows)
    with pytest.raises(ValueError):
        Z.visualize(index, "spiral")


def test_incremental_projection(spark, index):
    p = Z.pca(index)
    new = spark.createDataFrame([(1000, [1.0] * 8), (0, [9.0] * 8)], "id long, embedding array<double>")
    more = p.add(new)
    assert p.needs_update(new) and not more.needs_update(new) and more.points.count() == 61 and more.trained_on == 60
    with pytest.raises(ValueError, match="dimensions"):
        p.add(spark.createDataFrame([(7000, [1.0])], "id long, embedding array<double>"))


def test_leaks_and_exact_duplicates(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None), (5, "y"), (6, "x")], "id long, c string")
    assert sorted(map(tuple, D.exact_duplicates(df, "id", "c").collect())) == [(1, 3), (1, 6)]
    splits = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "a", 0)], "id long, split string, split_pos int")
    assert sorted(map(tuple, D.split_of(splits).collect())) == [(1, "b"), (2, "a")]


def test_model_source(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, "abcd")], "id long, text string")

    def load():
        def model(texts):
            if "bad" in texts:
                raise ValueError
            return [[float(len(t))] for t in texts]

        return model

    got = {r.id: list(r.embedding) for r in E.from_model(df, "id", "text", load).collect()}
    assert got == {1: [2.0], 3: [4.0]}
    assert E.resolve(df, "id").count() == 0
    assert E.resolve(df, "id", values={1: [1, 2], 9: [3, 4]}).count() == 1


def test_settings(tmp_path):
    parse = settings.parse_value
    assert [parse(x) for x in ("3", "1.5", "True", "none", "a,2", "x")] == [3, 1.5, True, None, ["a", 2], "x"]
    (tmp_path / "c.json").write_text('{"similarity_backend": "qdrant"}')
    s = settings.load(str(tmp_path / "c.json"), {"CURATRIX_VISUALIZATION_METHOD": "umap", "CURATRIX_QDRANT_URL": "http://x", "CURATRIX_SIMILARITY_BACKENDS": "*,own"})
    assert (s.similarity_backend, s.visualization_method, s.parameters["qdrant"]["url"], s.similarity_backends[-1]) == ("qdrant", "umap", "http://x", "own")
    assert settings.slug("My Data set!") == "my-data-set"
    name = settings.unique_name("abcdefghij", ["abcdefghij"], 10, random.Random(1))
    assert len(name) == 10 and name.startswith("abc-")
    assert register("own", "pgvector", max_k=7).max_k == 7 and PROFILES.pop("own").reverse


def test_runs(spark, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/runs")
    runs.register("a", {"k": 1})
    runs.save("a", "points", spark.range(3))
    with pytest.raises(ValueError):
        runs.register("a", {})
    runs.rename("a", "b")
    assert (runs.keys(), runs.config("b"), runs.load("b", "points").count()) == (["b"], {"k": 1}, 3)
    runs.cleanup("b")
    assert runs.keys() == []


def test_streams_equal_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([(k, [float(k)]), (0, [float(10 + k)])], "id long, embedding array<double>").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, embedding array<double>").parquet(src)
        maintain_index(stream, f"{tmp_path}/index", f"{tmp_path}/ckpt").trigger(availableNow=True).start().awaitTermination()
        if k == 1:
            compact_index(spark, f"{tmp_path}/index", 2)
    got = {r.id: r.embedding[0] for r in current_index(spark, f"{tmp_path}/index").rows.collect()}
    assert got == {0: 12.0, 1: 1.0, 2: 2.0}


def test_event_stream(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("counts").collect()) == sorted(tumbling_counts(spark.read.parquet(path)).collect())


def test_small_functions(spark):
    r = spark.createDataFrame([("5F9A0C3E1B2D4E6F8A9B0C1D",)], "i string").select(ids.to_uuid(F.col("i")).alias("u"), ids.from_uuid(ids.to_uuid(F.col("i"))).alias("b"), ids.to_uuid(F.lit("xyz")).alias("n"), V.parse_vector(F.lit("oops")).alias("p")).first()
    assert (r.u, r.b, r.n, r.p) == ("5f9a0c3e-1b2d-4e6f-8a9b-0c1d00000000", "5f9a0c3e1b2d4e6f8a9b0c1d", None, None)
    assert V.euclidean_threshold(0.5) == 1.0
