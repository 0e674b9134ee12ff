"""The public calls: sources, indexes, registered runs and stores by name, put together.

    index = compute_similarity(samples, embeddings="embedding", runs=runs, key="sim")
    index.sort_by_similarity("some-id", k=10)
    compute_near_duplicates(samples, 0.2, embeddings="embedding")

``samples`` is a table with a column ``id`` (or ``id_col``).  Labels are a list of
structs with ``id``; ``labels=`` indexes them instead of the samples, ``regions=``
pools them to one vector a sample.
"""

from __future__ import annotations

import logging
import numbers
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.functions import vectors as V
from curatrix.operators import duplicates, neighbors, objects, scores, visualization
from curatrix.operators.index import SimilarityIndex, build_index, clear_field, write_field
from curatrix.plans import settings
from curatrix.plans.fields import check_labels, data_field
from curatrix.plans.profiles import PROFILES
from curatrix.plans.runs import Runs
from curatrix.session import materialize
from curatrix.sources import embeddings as sources

log = logging.getLogger(__name__)
#: Classes of similarity results by store; stores without one use ``Similarity``.
BACKENDS: dict[str, type[Similarity]] = {}


def register_backend(name: str, kind: type[Similarity], *, base: str = "exact", **profile) -> None:
    """Add a store of one's own: a class of results, and what it allows."""
    from curatrix.plans import profiles

    profiles.register(name, base, **profile)
    BACKENDS[name] = kind


@dataclass
class Similarity:
    """A similarity index and what it was made from; changes replace ``index`` and are saved under ``key``."""

    index: SimilarityIndex
    backend: str = "exact"
    key: str | None = None
    runs: Runs | None = None
    model: Callable | None = None
    content: str | None = None
    embeddings_field: str | None = None
    labels: str | None = None
    config: dict = field(default_factory=dict)
    found: DataFrame | None = None
    thresh: float | None = None

    # State ------------------------------------------------------------------

    @property
    def total_index_size(self) -> int:
        return self.index.total_size()

    @property
    def index_size(self) -> int:
        return self.index.size()

    @property
    def missing_size(self) -> int | None:
        return self.index.missing_size()

    @property
    def has_view(self) -> bool:
        return self.index.has_view

    def use_view(self, collection: DataFrame, **options) -> Similarity:
        """Restrict what follows to ``collection(id)``; views nest, and a ``with`` block leaves the last one."""
        self.index = self.index.use_view(collection, **options)
        return self

    def __enter__(self) -> Similarity:
        return self

    def __exit__(self, *_: object) -> None:
        self.index = self.index.leave()

    def clear_view(self) -> None:
        self.index = self.index.clear()

    def current_ids(self) -> DataFrame:
        return self.index.current_ids()

    def reload(self) -> None:
        """Read the saved index again, if there is one, and forget what was found."""
        self.found, self.thresh = None, None
        if self.runs is not None and self.key in self.runs.keys():
            self.index = load_similarity(self.runs, self.key, self.config.get("_samples")).index
        else:
            self.index = self.index.reload()

    def save(self) -> None:
        """Write the index under its key: by value, or, if a field holds the vectors, by reference to it."""
        if self.runs is None or self.key is None:
            return
        rows = self.index.base if self.embeddings_field is None else self.index.base.drop("embedding")
        kept = materialize(rows, "saved")  # the run's own table may be what the index reads
        self.runs.save(self.key, "index", kept)
        if self.embeddings_field is None:
            self.index = SimilarityIndex(self.runs.load(self.key, "index"), metric=self.index.metric, center=self.index.center)

    def cleanup(self) -> None:
        """Delete the run and its tables."""
        if self.runs is not None and self.key is not None:
            self.runs.cleanup(self.key)

    # Changes ----------------------------------------------------------------

    def add_to_index(self, new: DataFrame, *, reload: bool = True, **options) -> None:
        """Upsert ``new(id, embedding, ...)``; ``reload=False`` leaves saving to a later call."""
        self.index = self.index.add(new, **options)
        self.found = None
        if reload:
            self.save()

    def remove_from_index(self, ids: DataFrame, *, by: str = "id", reload: bool = True, **options) -> None:
        """Delete ``ids(id)``; ``by="sample_id"`` deletes all labels of samples."""
        if by == "sample_id":
            ids = self.index.base.join(ids.select(F.col("id").alias("sample_id")).distinct(), "sample_id", "left_semi").select("id")
        self.index = self.index.remove(ids, **options)
        self.found = None
        if reload:
            self.save()

    def get_embeddings(self, ids: DataFrame | None = None, **options) -> DataFrame:
        """Rows of the view, or those of ``ids(id)`` in their order."""
        return self.index.rows if ids is None else self.index.get(ids, **options)

    def compute_embeddings(self, samples: DataFrame, *, model: Callable | None = None, content: str | None = None, id_col: str = "id", skip_existing: bool = False, warn_existing: bool = False, skip_failures: bool = True) -> DataFrame:
        """``id, embedding`` of ``samples`` by the given or the stored model; rows that the index has may be skipped."""
        model, content = model or self.model, content or self.content
        if model is None or content is None:
            raise ValueError("this index has no model: give one, and the field that it reads")
        if skip_existing:
            known = self.index.base.select(F.col("id").alias(id_col))
            if warn_existing and (n := samples.join(known, id_col, "left_semi").count()):
                log.warning("skipping %d ids that the index has", n)
            samples = samples.join(known, id_col, "left_anti")
        return sources.from_model(samples, id_col, content, model, skip_failures=skip_failures)

    def values(self, samples: DataFrame, value: str | Column, **options) -> DataFrame:
        return self.index.values(samples, value, label=self.labels, **options)

    # Queries ----------------------------------------------------------------

    def parse_query(self, query: object) -> tuple[list | None, list[list[float]] | None]:
        """Ids or vectors from what a caller may ask for.

        A vector, or several, is numbers with a fraction, an array or nested
        lists; whole numbers are ids where ids are.  Texts are ids if the index
        has them; otherwise all are prompts, which the model must support.
        """
        whole = isinstance(self.index.base.schema["id"].dataType, T.IntegralType)
        if isinstance(query, str) or (isinstance(query, numbers.Integral) and whole):
            query = [query]
        if isinstance(query, np.ndarray):
            query = query.tolist()
        query = list(query or [])
        if not query:
            raise ValueError("the query is empty")
        if all(isinstance(q, list | tuple | np.ndarray) for q in query):
            return None, [[float(x) for x in q] for q in query]
        if all(isinstance(q, str) for q in query):
            if whole:
                return None, self.embed_prompts(query)
            known = {r.id for r in self.index.base.where(F.col("id").isin(query)).select("id").collect()}  # the asked ones
            if len(known) == len(set(query)):
                return query, None
            if known or not self.supports_prompts:
                raise ValueError(f"not in the index: {[q for q in query if q not in known]}")
            return None, self.embed_prompts(query)
        if all(isinstance(q, numbers.Integral) for q in query) and whole:
            return [int(q) for q in query], None
        if all(isinstance(q, numbers.Real) for q in query):
            return None, [[float(q) for q in query]]
        raise ValueError("a query is ids, vectors or prompts, not a mixture")

    @property
    def supports_prompts(self) -> bool:
        return self.model is not None and hasattr(self.model(), "embed_prompts")

    def embed_prompts(self, prompts: list[str]) -> list[list[float]]:
        if not self.supports_prompts:
            raise ValueError("this index has no model that embeds prompts")
        return [[float(x) for x in v] for v in self.model().embed_prompts(prompts)]

    def sort_by_similarity(self, query: object, k: int | None = None, *, reverse: bool = False, aggregation: str = "mean") -> DataFrame:
        """``id, rank, dist`` of the view by distance to ids, vectors or prompts."""
        ids, vectors = self.parse_query(query)
        return neighbors.sort_by_similarity(self.index, ids, vectors=vectors, k=k, reverse=reverse, aggregation=aggregation, profile=self.backend)

    def write_distances(self, samples: DataFrame, ranked: DataFrame, name: str, *, id_col: str = "id") -> DataFrame:
        """``samples`` with the distances of a query in the field ``name``, of their labels in an index of labels."""
        if self.labels is None:
            return write_field(samples, ranked.select(F.col("id").alias(id_col), F.col("dist").alias(name)), name, id_col)
        return objects.write_label_field(samples, self.labels, ranked.select(F.col("id").alias("label_id"), F.col("dist").alias(name)), name, sample_id=id_col)

    def samples_in_order(self, ranked: DataFrame) -> DataFrame:
        """``sample_id, rank``: samples by their first label in a query's result, each once."""
        owners = self.index.base.select(F.col("id").alias("label_id"), "sample_id")
        return objects.samples_by_first_label(ranked, owners)

    def kneighbors(self, k: int, queries: DataFrame | None = None) -> DataFrame:
        return neighbors.kneighbors(self.index, k, queries)

    def radius_neighbors(self, thresh: float, **options) -> DataFrame:
        return neighbors.radius_neighbors(self.index, thresh, **options)

    def find_duplicates(self, thresh: float | None = None, *, fraction: float | None = None) -> DataFrame:
        """Duplicates within ``thresh``, or at the threshold that drops a ``fraction``; an unchanged threshold reuses the result."""
        if (thresh is None) == (fraction is None):
            raise ValueError("give a threshold or a fraction")
        if self.found is None or thresh is None or thresh != self.thresh:
            if thresh is None:
                self.found, self.thresh = duplicates.find_duplicates_fraction(self.index, fraction)
            else:
                self.found, self.thresh = duplicates.find_duplicates(self.index, thresh), thresh
        return self.found

    def find_unique(self, count: int) -> DataFrame:
        kept, self.thresh = duplicates.find_unique(self.index, count)
        return kept

    def _duplicates(self) -> DataFrame:
        if self.found is None:
            raise ValueError("call find_duplicates first")
        return self.found

    def duplicates_view(self, **options) -> DataFrame:
        return duplicates.duplicates_view(self._duplicates(), **options)

    def unique_view(self) -> DataFrame:
        return self._duplicates().where("type <> 'duplicate'").select("id")

    def neighbors_map(self) -> DataFrame:
        return duplicates.duplicate_groups(self._duplicates())

    # What plots are made of ---------------------------------------------------

    def plot_distances(self, bins: int = 100) -> DataFrame:
        return neighbors.nearest_histogram(self.index, bins)

    def visualize_duplicates(self, projection: visualization.Projection) -> tuple[DataFrame, DataFrame]:
        """Typed points, and the edges ``id, nearest_id, a, b`` between duplicates' points and their kept rows'."""
        found = self._duplicates()
        points = projection.points
        ends = found.where("type = 'duplicate'").select("id", "nearest_id")
        edges = ends.join(points.select("id", F.col("point").alias("a")), "id").join(points.select(F.col("id").alias("nearest_id"), F.col("point").alias("b")), "nearest_id")
        return visualization.point_types(projection, found), edges.select("id", "nearest_id", "a", "b")

    def visualize_unique(self, projection: visualization.Projection, unique: DataFrame) -> DataFrame:
        """``id, point, type``: unique or other."""
        mark = unique.select("id").distinct().withColumn("type", F.lit("unique"))
        return projection.points.join(mark, "id", "left").withColumn("type", F.coalesce("type", F.lit("other")))


def embeddings_of(
    samples: DataFrame, *, id_col: str = "id", embeddings: str | dict | bool | None = None, labels: str | None = None, regions: str | None = None, model: Callable | None = None, content: str | None = None,
    aggregate: Callable | None = None, skip_failures: bool = True,
) -> DataFrame:
    """``id, sample_id, embedding`` from a field, given values or a model, of samples, labels or pooled regions.

    Samples without regions take their own content's vector if a model embeds it,
    else they are left out.
    """
    within = labels or regions
    if within is not None:
        check_labels(samples, within)
    if isinstance(embeddings, str):
        name, exists = data_field(samples, embeddings, within)
        if model is None and not exists:
            raise ValueError(f"there is no field {embeddings!r}, and no model to fill it")
    else:
        name, exists = None, False
    if within is None:
        if model is not None and not exists:
            rows = sources.from_model(samples, id_col, content, model, skip_failures=skip_failures)
        else:
            rows = sources.resolve(samples, id_col, field=name, values=embeddings if isinstance(embeddings, dict) else None)
        return rows.select("id", F.col("id").alias("sample_id"), "embedding")
    if model is not None and not exists:
        flat = samples.select(F.col(id_col).alias("sample_id"), F.explode(within).alias("_l")).select("sample_id", F.col("_l.id").alias("id"), F.col(f"_l.{content}").alias(content))
        rows = flat.select("id", "sample_id").join(sources.from_model(flat, "id", content, model, skip_failures=skip_failures), "id")
    elif isinstance(embeddings, dict):
        flat = samples.select(F.col(id_col).alias("sample_id"), F.explode(within).alias("_l")).select("sample_id", F.col("_l.id").alias("id"))
        rows = flat.join(sources.from_values(samples.sparkSession, flat, "id", embeddings), "id")
    else:
        rows = sources.from_labels(samples, id_col, within, name).select("id", "sample_id", "embedding")
    if regions is None:
        return rows.select("id", "sample_id", "embedding")
    pooled = objects.pool(rows, aggregate=aggregate)
    return pooled.select(F.col("sample_id").alias("id"), "sample_id", "embedding")


def compute_similarity(
    samples: DataFrame, *, id_col: str = "id", embeddings: str | dict | bool | None = None, labels: str | None = None, regions: str | None = None, model: Callable | None = None, content: str | None = None,
    backend: str | None = None, metric: str | None = None, center: bool | None = None, runs: Runs | None = None, key: str | None = None, aggregate: Callable | None = None, pos: str | None = None,
    skip_failures: bool = True, progress: Callable[[str], None] | None = None,
) -> Similarity:
    """An index of samples, or of their labels, registered under ``key`` and filled.

    ``embeddings`` names the field that holds the vectors, or gives them by id;
    with ``model`` they are computed from ``content``.  ``False`` makes an empty
    index to be filled later.  ``backend`` names a store's profile (from the
    settings unless given); its first metric is the default one.  Vectors are
    centred for cosine only, unless told otherwise.  ``progress`` is told of steps.
    """
    tell = progress or (lambda _: None)
    defaults = settings.load()
    backend = backend or defaults.similarity_backend
    if backend not in PROFILES:
        raise ValueError(f"unknown store {backend!r}; there are {', '.join(sorted(PROFILES))}")
    metric = PROFILES[backend].check(metric, 1, False, lambda: 1)[0]
    if labels is not None and regions is not None:
        raise ValueError("give labels or regions, not both")
    config = {"backend": backend, "metric": metric, "embeddings_field": embeddings if isinstance(embeddings, str) else None, "labels": labels, "regions": regions, "id_col": id_col, "content": content, "pos": pos, **defaults.parameters.get(backend, {})}
    if runs is not None and key is not None:
        runs.register(key, {"type": "similarity", **config})  # an existing run is never overwritten
    tell("registered")
    if embeddings is False:
        kind = samples.schema[id_col].dataType.simpleString()
        rows = sources.empty(samples.sparkSession, kind).withColumn("sample_id", F.col("id"))
    else:
        rows = embeddings_of(samples, id_col=id_col, embeddings=embeddings, labels=labels, regions=regions, model=model, content=content, aggregate=aggregate, skip_failures=skip_failures)
    if pos is not None:
        rows = rows.join(samples.select(F.col(id_col).alias("sample_id"), F.col(pos).alias("_pos")), "sample_id", "left")
    if model is not None or isinstance(embeddings, dict):
        rows = materialize(rows, "embeddings")
    tell("embedded")
    index = build_index(rows, "id", "embedding", sample_id_col="sample_id" if labels else None, pos_col="_pos" if pos else None, metric=metric, center=metric == "cosine" if center is None else center)
    out = BACKENDS.get(backend, Similarity)(index, backend, key, runs, model, content, config["embeddings_field"] if model is None else None, labels, config)
    out.save()
    tell("indexed")
    return out


def load_similarity(runs: Runs, key: str, samples: DataFrame | None = None) -> Similarity:
    """The index saved under ``key``; one that refers to a field of its samples needs them."""
    config = runs.config(key)
    rows = runs.load(key, "index")
    if "embedding" not in rows.columns:
        if samples is None:
            raise ValueError(f"run {key!r} refers to the field {config['embeddings_field']!r} of its samples: give them")
        vectors = embeddings_of(samples, id_col=config["id_col"], embeddings=config["embeddings_field"], labels=config["labels"], regions=config["regions"])
        rows = rows.join(vectors.select("id", "embedding"), "id").select("id", "sample_id", "label_id", "pos", "embedding")
    index = SimilarityIndex(rows, metric=config["metric"], center=config["metric"] == "cosine")
    return BACKENDS.get(config["backend"], Similarity)(index, config["backend"], key, runs, None, config["content"], config["embeddings_field"], config["labels"], {**config, "_samples": samples})


def compute_near_duplicates(samples: DataFrame, thresh: float = 0.2, *, index: Similarity | None = None, **options) -> Similarity:
    """An index whose duplicates within ``thresh`` are found."""
    index = index or compute_similarity(samples, **options)
    index.find_duplicates(thresh)
    return index


def compute_exact_duplicates(samples: DataFrame, content: str, *, id_col: str = "id", order: str | None = None) -> DataFrame:
    return duplicates.exact_duplicates(samples, id_col, content, order)


def compute_leaky_splits(samples: DataFrame, splits: str | list[str] | dict[str, DataFrame], thresh: float = 0.2, *, id_col: str = "id", tags: str = "tags", index: Similarity | None = None, warn: bool = True, **options) -> tuple[Similarity, DataFrame, DataFrame]:
    """The index, ``id, split`` of its rows, and the leaks between splits; overlaps of splits and rows in none are warned of."""
    index = compute_near_duplicates(samples, thresh, index=index, id_col=id_col, **options)
    given = duplicates.splits_by(samples, splits, id_col=id_col, tags=tags)
    if warn:
        for r in duplicates.split_overlaps(given).collect():  # a row for each two splits
            log.warning("splits %s and %s share %d rows; the later one counts", r.split_a, r.split_b, r.n)
        if n := index.index.rows.join(given.select("id"), "id", "left_anti").count():
            log.warning("%d rows are in no split", n)
    of = duplicates.split_of(given)
    return index, of, duplicates.leaky_splits(index.found, of)


def compute_uniqueness(samples: DataFrame, *, index: Similarity | None = None, compat: bool = False, **options) -> DataFrame:
    """``id, uniqueness`` of the samples that have a vector."""
    index = index or compute_similarity(samples, **options)
    return scores.uniqueness(index.index, compat)


def compute_representativeness(samples: DataFrame, *, method: str = "cluster-center", index: Similarity | None = None, **options) -> DataFrame:
    """``id, representativeness``; ``cluster-center-downweight`` lowers rows near better ones."""
    if method not in ("cluster-center", "cluster-center-downweight"):
        raise ValueError(f"unknown method {method!r}")
    index = index or compute_similarity(samples, **options)
    return scores.representativeness(index.index, downweight=method != "cluster-center")


def compute_hardness(samples: DataFrame, labels: str, name: str = "hardness") -> DataFrame:
    """``samples`` with the entropy of ``labels.logits``; rows without logits get none."""
    check_labels(samples, labels, needs=("logits",))
    return samples.withColumn(name, scores.hardness(F.col(f"{labels}.logits")))


def compute_mistakenness(samples: DataFrame, predictions: str, truth: str = "ground_truth", name: str = "mistakenness", *, use_logits: bool = False) -> DataFrame:
    """``samples`` with the chance that a classification is wrong; lists of objects go through ``operators.objects``."""
    check_labels(samples, predictions, needs=("label", "logits" if use_logits else "confidence"))
    check_labels(samples, truth, needs=("label",))
    logits = F.col(f"{predictions}.logits") if use_logits else None
    confidence = None if use_logits else F.col(f"{predictions}.confidence")
    return samples.withColumn(name, scores.mistakenness(F.col(f"{predictions}.label"), F.col(f"{truth}.label"), confidence, logits))


def compute_visualization(samples: DataFrame, *, method: str | None = None, num_dims: int = 2, points: DataFrame | None = None, index: Similarity | None = None, runs: Runs | None = None, key: str | None = None, fields: dict | None = None, **options) -> visualization.Projection:
    """A projection by ``method`` (from the settings unless given), or of ``points``; saved under ``key``."""
    method = "manual" if points is not None else method or settings.load().visualization_method
    if method == "manual":
        out = visualization.manual(points)
    else:
        own = {k: options.pop(k) for k in ("fit_rows", "perplexity", "learning_rate", "max_iters", "num_neighbors", "min_dist", "seed") if k in options}
        index = index or compute_similarity(samples, **options)
        out = visualization.visualize(index.index, method, num_dims, **own)
    if runs is not None and key is not None:
        runs.register(key, {"type": "visualization", "method": method, "num_dims": num_dims, "fields": fields or {}})
        runs.save(key, "points", out.points)
    return out


def remove_embeddings(samples: DataFrame, ids: DataFrame, name: str, *, id_col: str = "id", labels: str | None = None) -> DataFrame:
    """``samples`` with the vectors of ``ids(id)`` null; with ``labels``, those of the label ids, or of all labels of samples."""
    if labels is None:
        return clear_field(samples, ids.select(F.col("id").alias(id_col)), name, id_col)
    return objects.clear_label_field(samples, labels, ids.select(F.col("id").alias("label_id")), name, sample_id=id_col)


def add_embeddings(samples: DataFrame, new: DataFrame, name: str, *, id_col: str = "id", labels: str | None = None) -> DataFrame:
    """``samples`` with the vectors of ``new(id, embedding)`` in the field ``name``, of the samples or of their labels."""
    vectors = new.select("id", V.vector("embedding").alias(name))
    if labels is None:
        return write_field(samples, vectors.withColumnRenamed("id", id_col), name, id_col)
    return objects.write_label_field(samples, labels, vectors.withColumnRenamed("id", "label_id"), name, sample_id=id_col)
