"""The corpus pipeline, stage by stage, against plain Python."""

import zlib

import numpy as np

import corpus_pipeline
from curatrix.llm import labelled, packing, quality, secrets
from tests.llm.test_minhash_and_media import brute, lower
from tests.llm.test_secrets_and_decontamination import WORD
from tests.llm.test_tokens import ids

SF = "/root/testdata/sf0.001"


def cut(text, items, window):
    """Text without the windows of items, and its share of hit words."""
    m = list(WORD.finditer(lower(text)))
    words, hit = [x[0] for x in m], set()
    for item in items:
        w = WORD.findall(lower(item or ""))
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out += [text[at : m[i].start()], " "]
        at = m[i].end()
    return "".join([*out, text[at:]]), len(hit) / max(1, len(words))


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(labelled.fold(3) != 1)
    good = {r.doc_id for r in quality.score_quality(docs, labels).where("score >= 0.5").collect()}
    rows = {i: t for i, t in rows.items() if i in good}
    found = brute(list(rows.items()), 5, 80, WORD.findall)
    rows = {i: t for i, t in rows.items() if found[i][1] == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {}
    for i, t in rows.items():
        text, share = cut(t or "", items, 10)
        if share <= 0.5:
            kept[i] = secrets.redacted(text, secrets.spans_of(text)[1])
    want = {}
    for i, t in kept.items():
        raw = [*ids(t), 0]
        for lo in range(0, len(raw), 2048):
            piece = np.array(raw[lo : lo + 2048], "<u4").tobytes()
            want[i, lo // 2048] = (lo, len(piece) // 4, zlib.crc32(piece))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    check_places(got)
    assert len(kept) < len(good) and 0 < len(kept)


def check_places(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * total / 2048 + 2


def test_packing_fills_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_places(packing.pack_documents(docs, include_ids=False).collect())


def test_stages_keep_columns_and_clean_documents(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    clean = [(i, " ".join(f"word{i}x{k}" for k in range(40)), "en", "s", 300) for i in range(30)]
    odd = [(100, None, None, None, None), (101, "", "en", "s", 0), (None, "no id here", "en", "s", 10)]
    docs = spark.createDataFrame(clean + odd, ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "string", "string", "string", "long"), strict=True)))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == names, name
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_repeated_and_missing_ids_lose_no_text(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(5, a), (5, b), (5, b), (9, a + " more"), (None, c), (None, c), (None, a), (None, d + " tail"), (7, d), (None, None), (None, None), (None, ""), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n_chars long")
    for parts in (1, 5):
        out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), SF)
        want = [(5, a), (5, b), (None, c), (7, d), (None, None), (None, None), (None, ""), (3, None)]
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
