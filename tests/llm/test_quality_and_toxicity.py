"""Held-out accuracy of both classifiers, and their behaviour on odd input."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curatrix.llm import labelled, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality", "quality", 0.9), ("op6_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    out = queries.queries()[name](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = out.where("held_out").join(labels, "doc_id").toPandas()
    assert out.count() == docs.count()
    assert auc(rows.score.to_numpy(), rows[label].to_numpy()) >= least
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()
    assert rows.score.between(0, 1).all()
    # Calibrated well enough that the threshold of a half means something.
    assert (rows.predicted == rows[label]).mean() >= 0.85


@pytest.mark.parametrize(("score", "label"), [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_odd_rows(spark, score, label):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "word " * 200_000, 0.0), (None, "x", 0.0), (1, None, 0.0), (4, " é😀", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(3, None), (3, 1), (3, 0), (9, 1), (None, 1)], f"doc_id long, {label} int")
    got = score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert score(docs.limit(0), labels).count() == 0
    assert [r.score for r in score(docs.limit(2), labels.limit(0)).collect()] == [0.5, 0.5]


def test_samples_are_bounded(spark):
    docs = spark.range(500).selectExpr("cast(1 AS long) AS doc_id", "concat('text ', id) AS text").unionByName(spark.range(2, 40).selectExpr("id AS doc_id", "concat('other ', id) AS text"))
    labels = spark.range(1, 40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    got = labelled.sample(docs, labels, "quality", rows=60, text_bytes=100)
    assert len(got) == 39 and got.text.is_unique and "text 0" in set(got.text)
    assert len(labelled.sample(docs, labels, "quality", rows=10, text_bytes=100)) == 10


def test_rows_without_an_id_have_a_fold(spark):
    row = spark.createDataFrame([(None,), (7,)], "doc_id long").select((labelled.fold(3) == 1).alias("a"), (labelled.fold(5) == 0).alias("b"), labelled.fold(3).alias("c")).collect()
    assert (row[0].a, row[0].b, row[1].c) == (False, True, labelled.fold_of(7, 3))


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def plain_slot(word):
    """Slot of a token by its definition: a polynomial of its folded bytes."""
    total, power = 0, 1
    for c in word.encode():
        total += mixed((c + 32 * (65 <= c <= 90) + 1) * 0x9E3779B97F4A7C15 % 2**64) * power
        power = power * 0x2545F4914F6CDD1D % 2**64
    return mixed((total + len(word.encode())) % 2**64) % quality.SLOTS


def plain_quality(model, text):
    """The fitted model applied token by token."""
    tokens = re.findall(r"[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^A-Za-z0-9\x80-\U0010ffff\t-\r ]+", text)
    index = quality.index_table()
    ids = [plain_slot(t) for t in tokens]
    n = len(ids)
    x = [0.0] * (2 * quality.DIM + 8)
    for i in ids:
        for k in range(quality.DIM):
            x[k] += float(model.context[i, k]) / n
            x[quality.DIM + k] += float(index[i, k]) / n
    d = 2 * quality.DIM
    x[d] = math.log1p(n)
    for t in tokens:
        x[d + 1 + (0 if t[0].isalpha() or ord(t[0]) > 127 else 1 if t[0] in "0123456789" else 2)] += 1 / n
    x[d + 4] = sum(abs(model.context[i, 0]) + abs(model.context[i, 1]) > 0 for i in ids) / max(n, 1)
    x[d + 5] = math.log(sum(v * v for v in x[quality.DIM : d]) + 1e-3)
    x[d + 6] = math.log(sum(v * v for v in x[: quality.DIM]) + 1e-3)
    x[d + 7] = sum(a == b for a, b in zip(ids, ids[1:])) / max(n, 1)
    z = [(v - c) / s for v, c, s in zip(x, model.centre, model.scale)]
    hidden = [math.tanh(sum(v * model.w1[k, j] for k, v in enumerate(z)) + model.b1[j]) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, model.w2)) + model.b2) / model.temperature))


def plain_toxicity(model, text):
    """The fitted model applied n-gram by n-gram."""
    p = [ord(c) if ord(c) > 127 or c in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in f" {text.lower()} "]
    slots = set()
    for n in toxicity.SIZES:
        for k in range(len(p) - n + 1):
            if 32 not in p[k + 1 : k + n - 1]:
                h = n * 0x01000193 + sum(c * int(m) for c, m in zip(p[k : k + n], toxicity._C))
                h %= 2**32
                h = (h ^ (h >> 15)) * 0x2C1B3C6D % 2**32
                slots.add(h >> (32 - toxicity.BITS))
    return 1 / (1 + math.exp(-(model.bias + sum(float(model.weight[s]) for s in slots))))


def test_registered_scores_against_plain_python(spark, monkeypatch):
    """Both queries' scores of all documents of a table, from the models that they fitted."""
    sf = "/root/testdata/sf0.001"
    models = {}
    for module, name in ((quality, "op3_quality"), (toxicity, "op6_toxicity")):
        fit = module.fit
        monkeypatch.setattr(module, "fit", lambda *a, fit=fit, name=name, **k: models.setdefault(name, fit(*a, **k)))
    docs = {r.doc_id: (r.text or "")[:3000] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    short = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for score, plain, name in ((quality.score_quality, plain_quality, "op3_quality"), (toxicity.score_toxicity, plain_toxicity, "op6_toxicity")):
        for r in score(short, labels).collect():
            assert abs(r.score - plain(models[name], docs[r.doc_id])) < 1e-4, r.doc_id


def test_quality_rests_on_the_vectors(spark):
    """Without the pooled vectors the hand-made features alone do worse than the vectors alone."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    data = labelled.sample(spark.read.parquet(f"{SF}/documents.parquet"), labels, "quality", rows=4000, text_bytes=16 << 10)
    texts, y = data.text.tolist(), data.y.to_numpy()
    held = np.arange(len(y)) % 3 == 0
    context = quality.context_vectors([t for t, h in zip(texts, held) if not h])
    x = quality.features(context, pa.array(texts))
    x = (x - x[~held].mean(0)) / (x[~held].std(0) + 1e-6)
    got = {}
    for name, part in (("vectors", slice(0, 2 * quality.DIM)), ("shapes", slice(2 * quality.DIM, None)), ("all", slice(0, None))):
        p = quality._train(x[~held][:, part], y[~held].astype(float), np.ones((~held).sum()), 400, 11)
        got[name] = auc(quality._logits(x[held][:, part], p[0], p[1], p[2], p[3][0]), y[held])
    print("held-out AUC", got)
    assert got["vectors"] >= 0.85 and got["all"] >= got["shapes"] - 0.01


def test_quality_features_do_not_depend_on_the_batch():
    texts = ["", "a b c a b", "x" * 50, "one, two; 3 4 5", "lorem " * 30_000, ""]
    context = quality.context_vectors(texts)
    together = quality.features(context, pa.array(texts))
    alone = np.vstack([quality.features(context, pa.array([t])) for t in texts])
    assert np.allclose(together, alone, atol=1e-4)


def test_toxicity_slots_stay_inside_words():
    assert sum(len(s) for s in toxicity.slots("ab")) == 3  # " ab", "ab ", " ab "
    assert sum(len(s) for s in toxicity.slots("")) == 0


def test_keep_quality_keeps_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    scored = quality.score_quality(docs, labels).where(F.col("score") >= 0.5)
    assert kept.count() == scored.count()
