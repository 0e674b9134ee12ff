"""Every registered query of the library itself against its SQL; the others against stated properties."""

import pytest

from curatrix import catalog
from tests.compare import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert rows_of(catalog.queries()[name](spark, SF)) == rows_of_sql(con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["pca_projection", "pca_incremental", "tsne_projection", "umap_projection"])
def test_projections_cover_all_rows(spark, name):
    rows = catalog.queries()[name](spark, SF).toPandas()
    assert sorted(rows.id) == list(range(500))
    assert rows.notna().all().all()


def test_unique_subset_is_spread(spark):
    assert catalog.queries()["unique_subset"](spark, SF).count() == 100


def test_umap_lays_out_the_whole_index(spark, monkeypatch):
    """All rows are fitted; none is placed among others."""
    monkeypatch.setattr(catalog.Z, "_placed", None)
    assert catalog.queries()["umap_projection"](spark, SF).count() == 500


def test_unique_half_looks_at_all_rows(spark):
    ids = {r.id for r in catalog.queries()["unique_half"](spark, SF).collect()}
    assert len(ids) == 250 and max(ids) >= 450


def test_kmeans_scores(spark):
    rows = catalog.queries()["representativeness_kmeans"](spark, SF).toPandas()
    assert len(rows) == 500 and rows.representativeness.between(0, 1).all() and rows.representativeness.max() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
