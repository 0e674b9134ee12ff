"""The public calls, stores, models and checks of fields."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix import analysis as A
from curatrix.functions import vectors as V
from curatrix.operators import duplicates as D
from curatrix.operators import neighbors as N
from curatrix.operators import objects as O
from curatrix.operators import visualization as Z
from curatrix.operators.index import build_index, same_ids
from curatrix.plans import profiles
from curatrix.plans.fields import check_labels, check_scalar_field, data_field
from curatrix.plans.models import Models
from curatrix.plans.runs import Runs
from curatrix.sources.stores import StoreSource


def ids_of(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], f"id {'string' if isinstance(ids[0], str) else 'long'}")


@pytest.fixture(scope="module")
def vectors():
    return np.random.default_rng(3).normal(size=(40, 4)).round(3)


@pytest.fixture(scope="module")
def samples(spark, vectors):
    rows = [(f"s{i:02}", i, [float(x) for x in v], "text " * (i % 5)) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id string, pos long, emb array<double>, text string").cache()


def test_text_ids(spark, samples, vectors):
    i = build_index(samples, "id", "emb", metric="euclidean", center=False)
    d = np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(2)).round(9)
    np.fill_diagonal(d, np.inf)
    got = {(r.query_id, r.rank): r.id for r in N.kneighbors(i, 2).collect()}
    assert got == {(f"s{a:02}", k + 1): f"s{b:02}" for a in range(40) for k, b in enumerate(sorted(range(40), key=lambda b: (d[a, b], b))[:2])}
    want = {(f"s{a:02}", f"s{b:02}") for a in range(40) for b in range(a + 1, 40) if d[a, b] <= 1.5}
    for options in ({}, {"cells": 5}):
        assert {(r.id_a, r.id_b) for r in N.radius_neighbors(i, 1.5, **options).collect()} == want
    assert D.find_duplicates(i, 1.5).count() == 40
    with pytest.raises(ValueError, match="prune"):
        N.radius_neighbors(build_index(samples, "id", "emb", metric="l1"), 1.0, cells=2)


def test_tiles_of_several_blocks(spark, samples, monkeypatch):
    i = build_index(samples, "id", "emb")
    want = sorted(map(tuple, N.kneighbors(i, 3).collect())), sorted(map(tuple, N.radius_neighbors(i, 0.5).collect()))
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "TILE", 11)
    assert (sorted(map(tuple, N.kneighbors(i, 3).collect())), sorted(map(tuple, N.radius_neighbors(i, 0.5).collect()))) == want
    assert sorted(map(tuple, N.radius_neighbors(i, 0.5, cells=4).collect())) == want[1]


def test_unlike_lengths_raise(spark):
    i = build_index(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "id", "v")
    with pytest.raises(ValueError, match="dimensions"):
        N.kneighbors(i, 1)
    with pytest.raises(ValueError, match="dimensions"):
        N.radius_neighbors(i, 1.0)


def test_find_unique_doubles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 3)) * 50
    i = build_index(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, v array<double>"), "id", "v", metric="euclidean", center=False)
    kept, thresh = D.find_unique(i, 3)
    assert kept.count() == 3 and thresh > 2
    with pytest.raises(ValueError, match="distance"):
        D.find_unique(build_index(i.base, "id", "embedding", metric="dotproduct"), 3)


def test_both_greedy_passes_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(map(int, p))) for p in rng.integers(0, 200, (500, 2)) if p[0] != p[1]}
    edges = spark.createDataFrame(sorted(pairs), "id_a long, id_b long")
    kept = []
    for k in sorted({x for p in pairs for x in p}):
        if not any((j, k) in pairs for j in kept):
            kept.append(k)
    assert sorted(r.id for r in D.greedy_kept(edges).collect()) == kept
    monkeypatch.setattr(D, "FEW_EDGES", 0)
    assert sorted(r.id for r in D.greedy_kept(edges).collect()) == kept
    assert D.greedy_kept(edges.limit(0)).count() == 0


def test_views_check_both_directions(spark, samples):
    i = build_index(samples, "id", "emb")
    view = ids_of(spark, "s03", "s01", "zz")
    assert i.use_view(view).size() == 2 and i.use_view(view).missing_size() == 1
    with pytest.raises(ValueError, match="index are not in the collection"):
        i.use_view(view, allow_missing=False)
    with pytest.raises(ValueError, match="not in the index"):
        i.use_view(samples.select("id").union(ids_of(spark, "zz")), allow_missing=False)
    whole = i.use_view(samples.select("id"), allow_missing=False)
    assert not whole.has_view and whole.missing_size() == 0 and i.missing_size() is None
    inner = i.use_view(view).use_view(ids_of(spark, "s01"))
    assert inner.size() == 1 and inner.leave().size() == 2 and inner.leave().leave().size() == 40 and inner.clear().size() == 40
    ordered = i.use_view(spark.createDataFrame([("s03", 0), ("s01", 1), ("s03", 2)], "id string, p int"), order="p")
    assert [r.id for r in ordered.current_ids().collect()] == ["s03", "s01", "s03"]
    with i.viewing(view) as v:
        assert v.size() == 2
    assert same_ids(i.base, samples) and not same_ids(i.base, view)


def test_appended_rows_come_last(spark, samples):
    i = build_index(samples, "id", "emb", pos_col="pos")
    new = spark.createDataFrame([("b", [1.0] * 4), ("a", [2.0] * 4), ("a", [3.0] * 4), ("s00", [9.0] * 4)], "id string, embedding array<double>").coalesce(1)
    rows = i.add(new).current_ids().collect()
    assert [r.id for r in rows[:2]] == ["s00", "s01"] and [r.id for r in rows[-2:]] == ["a", "b"]
    assert i.add(new).rows.where("id = 'a'").first().embedding[0] == 3.0


class Model:
    def __call__(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def embed_prompts(self, prompts):
        return [[float(len(p)), 1.0] for p in prompts]


def test_similarity_from_field_to_run(spark, samples, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/runs")
    steps = []
    s = A.compute_similarity(samples, embeddings="emb", runs=runs, key="sim", pos="pos", progress=steps.append)
    assert steps == ["registered", "embedded", "indexed"] and s.total_index_size == 40
    with pytest.raises(ValueError, match="exists"):
        A.compute_similarity(samples, embeddings="emb", runs=runs, key="sim")
    assert "embedding" not in runs.load("sim", "index").columns
    with pytest.raises(ValueError, match="refers to the field"):
        A.load_similarity(runs, "sim")
    back = A.load_similarity(runs, "sim", samples)
    want = s.sort_by_similarity("s05", 4).collect()
    assert back.sort_by_similarity(["s05"], 4).collect() == want and want[0].id == "s05"
    with s.use_view(ids_of(spark, "s05", "s06")):
        assert s.index_size == 2 and s.has_view
    assert s.index_size == 40
    s.remove_from_index(ids_of(spark, "s05"))
    assert A.load_similarity(runs, "sim", samples).total_index_size == 39
    s.cleanup()
    assert runs.keys() == []


def test_similarity_by_values_and_model(spark, samples, tmp_path):
    runs = Runs(spark, f"file://{tmp_path}/runs")
    s = A.compute_similarity(samples, embeddings={"s01": [1, 0], "s02": [0, 1], "zz": [1, 1]}, runs=runs, key="own")
    assert s.total_index_size == 2
    s.add_to_index(spark.createDataFrame([("new", [1.0, 1.0])], "id string, embedding array<double>"))
    back = A.load_similarity(runs, "own")
    back.reload()
    assert back.total_index_size == 3
    late = A.compute_similarity(samples, embeddings=False, model=Model, content="text", metric="euclidean")
    assert late.total_index_size == 0
    late.add_to_index(late.compute_embeddings(samples.where("pos < 10")))
    assert late.total_index_size == 10 and late.compute_embeddings(samples, skip_existing=True, warn_existing=True).count() == 30
    assert late.sort_by_similarity("no such id", 1).first().dist == 0.0  # a prompt of ten letters
    with pytest.raises(ValueError, match="not in the index"):
        late.sort_by_similarity(["s01", "no such id"], 1)
    for bad in ([], [1.0, "x"], [[1.0], "x"]):
        with pytest.raises(ValueError):
            late.sort_by_similarity(bad, 1)
    with pytest.raises(ValueError, match="not in the index"):
        s.sort_by_similarity("no such id", 1)
    with pytest.raises(ValueError, match="no model"):
        s.compute_embeddings(samples)
    with pytest.raises(ValueError, match="unknown store"):
        A.compute_similarity(samples, embeddings="emb", backend="nowhere")
    with pytest.raises(ValueError, match="no field"):
        A.compute_similarity(samples, embeddings="nothing")


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [("a", [("a1", [1.0, 0.0]), ("a2", [0.0, 1.0])]), ("b", [("b1", [1.0, 1.0]), ("b2", None)]), ("c", []), ("d", None)]
    return spark.createDataFrame(rows, "id string, boxes array<struct<id:string,emb:array<double>>>")


def test_labels_and_regions(spark, labelled):
    s = A.compute_similarity(labelled, embeddings="boxes.emb", labels="boxes", metric="euclidean")
    ranked = s.sort_by_similarity("a1", 3)
    assert [r.id for r in ranked.collect()] == ["a1", "b1", "a2"]
    assert [(r.sample_id, r["rank"]) for r in s.samples_in_order(ranked).collect()] == [("a", 1), ("b", 2)]
    out = {r.id: [x.near for x in r.boxes or []] for r in s.write_distances(labelled, ranked, "near").collect()}
    assert out["a"][0] == 0.0 and out["b"][1] is None and out["c"] == [] and out["d"] == []
    assert s.values(labelled, "boxes.emb").count() == 3
    s.remove_from_index(ids_of(spark, "a"), by="sample_id")
    assert [r.id for r in s.index.rows.collect()] == ["b1"]
    by_dict = A.compute_similarity(labelled, embeddings={"a1": [1, 2], "b2": [3, 4], "zz": [5, 6]}, labels="boxes")
    assert sorted(r.id for r in by_dict.index.rows.collect()) == ["a1", "b2"]
    mean = {r.id: list(r.embedding) for r in A.compute_similarity(labelled, embeddings="emb", regions="boxes").index.rows.collect()}
    assert mean == {"a": [0.5, 0.5], "b": [1.0, 1.0]}
    most = A.compute_similarity(labelled, embeddings="emb", regions="boxes", aggregate=lambda e: e.max(0))
    assert {r.id: list(r.embedding) for r in most.index.rows.collect()} == {"a": [1.0, 1.0], "b": [1.0, 1.0]}
    new = spark.createDataFrame([("b2", [7.0, 7.0]), ("zz", [0.0, 0.0])], "id string, embedding array<double>")
    added = A.add_embeddings(labelled, new, "emb", labels="boxes")
    assert {x.id: x.emb for r in added.collect() for x in r.boxes or []}["b2"] == [7.0, 7.0]
    gone = A.remove_embeddings(added, ids_of(spark, "a1", "b2"), "emb", labels="boxes")
    assert {x.id for r in gone.collect() for x in r.boxes or [] if x.emb is None} == {"a1", "b2"}
    wanted = spark.createDataFrame([("a1",), ("zz",)], "label_id string")
    with pytest.raises(ValueError, match="not in 'boxes'"):
        O.label_owners(labelled, "boxes", wanted, sample_id="id", allow_missing=False)


def test_field_checks(labelled, samples):
    assert data_field(labelled, "boxes.emb", "boxes") == ("emb", True) and data_field(labelled, "none", "boxes") == ("none", False)
    assert data_field(samples, "emb") == ("emb", True)
    for bad in (lambda: data_field(samples, "no.field"), lambda: data_field(samples, 3), lambda: check_scalar_field(labelled, "boxes"), lambda: check_scalar_field(labelled, "boxes.emb"), lambda: check_labels(labelled, "id"), lambda: check_labels(labelled, "none"), lambda: check_labels(labelled, "boxes", view_of="others"), lambda: check_labels(labelled, "boxes", frames=True)):
        with pytest.raises(ValueError):
            bad()
    check_scalar_field(samples, "emb")
    check_labels(labelled, "boxes", view_of=("boxes", "others"))


def test_duplicates_leaks_and_scores(spark, samples):
    s = A.compute_near_duplicates(samples, 0.4, embeddings="emb")
    assert s.thresh == 0.4 and s.find_duplicates(0.4) is s.found
    n = s.found.where("type = 'duplicate'").count()
    assert 0 < n == 40 - s.unique_view().count()
    assert sum(len(r.duplicates) for r in s.neighbors_map().collect()) == n
    points, edges = s.visualize_duplicates(A.compute_visualization(samples, method="pca", index=s))
    assert points.count() == 40 and edges.count() == n
    assert s.visualize_unique(Z.pca(s.index), s.find_unique(10)).where("type = 'unique'").count() == 10
    tagged = samples.withColumn("tags", F.array(F.when(F.col("pos") % 2 == 0, "even").otherwise("odd")))
    forms = ["even", "odd"], {"even": samples.where("pos % 2 = 0"), "odd": samples.where("pos % 2 = 1")}, "parity"
    got = [sorted(map(tuple, A.compute_leaky_splits(tagged.withColumn("parity", F.get("tags", 0)), f, 0.4, index=s)[2].collect())) for f in forms]
    assert got[0] == got[1] == got[2] and got[0]
    with pytest.raises(ValueError, match="threshold or"):
        s.find_duplicates()
    assert A.compute_uniqueness(samples, index=s).count() == 40
    for method in ("cluster-center", "cluster-center-downweight"):
        assert A.compute_representativeness(samples, index=s, method=method).count() == 40
    rows = spark.createDataFrame([(("a", 0.9, [1.0, 0.0]), ("a",)), (("a", 0.8, None), ("b",))], "pred struct<label:string,confidence:double,logits:array<double>>, gt struct<label:string>")
    assert [r.mistakenness for r in A.compute_mistakenness(rows, "pred", "gt").collect()] == [pytest.approx(0.05), pytest.approx(0.9)]
    assert A.compute_hardness(rows, "pred").where("hardness is null").count() == 1
    with pytest.raises(ValueError, match="labels need"):
        A.compute_mistakenness(rows, "gt", "pred", use_logits=True)


class Reversed(A.Similarity):
    def sort_by_similarity(self, query, k=None, **options):
        return super().sort_by_similarity(query, k, **options | {"reverse": True})


def test_own_stores_and_methods(samples):
    A.register_backend("turned", Reversed)
    try:
        assert isinstance(s := A.compute_similarity(samples, embeddings="emb", backend="turned"), Reversed)
        assert s.sort_by_similarity("s01", 1).first().id != "s01"
    finally:
        A.BACKENDS.pop("turned"), profiles.PROFILES.pop("turned")
    Z.register_method("first", lambda index, n: Z.manual(index.rows.select("id", F.slice("embedding", 1, n).alias("point"))))
    try:
        assert Z.visualize(build_index(samples, "id", "emb"), "first").points.count() == 40
    finally:
        Z.METHODS.pop("first")


def test_projections(spark, samples, vectors, tmp_path):
    i = build_index(samples, "id", "emb")
    got = {r.id: r.point for r in Z.pca(i, 3).points.collect()}
    x = vectors - vectors.mean(0)
    want = x @ np.linalg.svd(x, full_matrices=False)[2][:3].T
    assert np.allclose(np.abs([got[f"s{k:02}"] for k in range(40)]), np.abs(want), atol=1e-6)
    assert Z.pca(i.restrict(ids_of(spark, "none"))).points.count() == 0
    assert Z.visualize(i.restrict(ids_of(spark, "none")), "umap").points.count() == 0
    runs = Runs(spark, f"file://{tmp_path}/runs")
    p = A.compute_visualization(samples, method="umap", embeddings="emb", runs=runs, key="v", max_iters=20, fields={"points": "pt"})
    assert runs.load("v", "points").count() == 40
    assert p.training(i.rows).count() == 40
    with pytest.raises(ValueError, match="fitted on"):
        p.training(i.rows.where("id <> 's03'"))
    view = p.restrict(ids_of(spark, "s01", "s02"))
    assert view.points.count() == 2 and view.clear().points.count() == 40
    df = samples.withColumn("pt", F.lit(1))
    assert "points2" in runs.rename_fields("v", {"points": "points2"}, df).columns
    assert "points2" not in runs.cleanup("v", df.withColumnRenamed("pt", "points2")).columns and runs.keys() == []


def test_neighbour_graphs():
    rng = np.random.default_rng(0)
    d = np.sort(rng.random((50, 15)), 1)
    near, width = Z.smooth_distances(d)
    assert np.allclose(np.exp(-np.maximum(d - near[:, None], 0) / width[:, None]).sum(1), np.log2(15), atol=1e-3)
    lo, hi, w = Z.fuzzy_union(4, np.array([0, 1, 2]), np.array([1, 0, 3]), np.array([0.5, 0.4, 0.3]))
    assert lo.tolist() == [0, 2] and hi.tolist() == [1, 3] and np.allclose(w, [0.7, 0.3])
    a, b = Z.curve(0.1)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02
    x = np.vstack([rng.normal(size=(40, 5)) + c for c in (0, 12, 24)])
    y = Z._umap(x, (x - x.mean(0))[:, :2], 10, 0.1, "euclidean", 100, 0)
    own = np.repeat(np.arange(3), 40)
    dist = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(dist, np.inf)
    assert (own[dist.argmin(1)] == own).mean() > 0.95


def test_rank_of_all_rows(spark, samples):
    i = build_index(samples, "id", "emb")
    rows = N.sort_by_similarity(i, ["s00"]).collect()
    assert [r["rank"] for r in rows] == list(range(1, 41)) and [r.dist for r in rows] == sorted(r.dist for r in rows)


def test_stores(spark, tmp_path):
    spark.dataSource.register(StoreSource)
    options = {"client": "curatrix.sources.stores:folder_store", "root": f"{tmp_path}/store", "parts": "3"}
    rows = spark.range(500).selectExpr("cast(id as string) AS id", "cast(id as string) AS sample_id", "cast(null as string) AS label_id", "array(cast(id as double), 1.0D) AS embedding")
    rows.write.format("vector_store").options(write_batch="50", **options).mode("append").save()
    rows.where("id < 10").withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0))).write.format("vector_store").options(**options).mode("append").save()
    back = spark.read.format("vector_store").options(page="64", **options).load()
    assert back.count() == 500 and back.where("embedding[1] = 0").count() == 10
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        asked = spark.read.format("vector_store").options(pushdown="true", **options).load()
        assert [r.embedding[0] for r in asked.where("id = '77'").collect()] == [77.0]
        some = asked.where(F.col("id").isin("3", "499", "zz"))
        assert sorted(r.id for r in some.collect()) == ["3", "499"] and some.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def load_length(path):
    with open(path) as f:
        k = float(f.read())
    return lambda texts: [[k * len(t)] for t in texts]


def test_models(tmp_path):
    (tmp_path / "weights").write_text("2")
    m = Models(str(tmp_path / "models"))
    m.add("length", "1.9", "tests.test_analysis:load_length", str(tmp_path / "weights"))
    m.add("length", "1.10", "tests.test_analysis:load_length", str(tmp_path / "weights"))
    assert m.names() == ["length"] and m.find("length").version == "1.10" and m.load("length")(["abc"]) == [[6.0]]
    with pytest.raises(ValueError, match="exists"):
        m.add("length", "1.9", "x:y")
    m.delete("length", "1.10")
    assert m.find("length").version == "1.9"
    m.delete("length")
    with pytest.raises(ValueError, match="no model"):
        m.find("length")


def test_softmax_binds_its_terms_once(spark):
    plan = spark.createDataFrame([([1.0, 2.0],)], "l array<double>").select(V.softmax(F.col("l")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_max") == 1
