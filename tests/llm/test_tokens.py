"""The cached encoder gives what the library gives, and token files read back exactly."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curatrix.llm import kernels as K
from curatrix.llm import packing, queries, token_store, tokens
from curatrix.llm.tokens import Encoder, default_tokenizer

VOCABULARY = open(default_tokenizer(), encoding="utf-8").read()  # noqa: SIM115
LIBRARY = Tokenizer.from_str(VOCABULARY)
ALPHABETS = ["abc XYZ 'sdtlmrev.,;!?-", "aéßÀİıſŉǅʯȺ ", "naïve “quoted” — … 12²½ª", "а΄Σς ήλιος ", "\x1c\x85 \xa0 　x", "<|startoftext|> end", "日本語 한국어 ", "é ö̀ ", "😀👩‍💻 q"]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_encoder_equals_library(alphabet):
    rng, enc = random.Random(7), Encoder(VOCABULARY, cached=200)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(400)]
    for text in texts:
        assert enc.encode(text) == ids(text), repr(text)
    together(enc, texts)


def together(enc, texts):
    """Blocks of several texts give what single texts do."""
    at = 0
    for block in K.blocks(pa.array(texts, pa.string()), 300):
        got, edge = enc.encode_block(block)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            assert got[lo:hi].tolist() == ids(texts[at]), repr(texts[at])
            at += 1
    assert at == len(texts)


def test_all_alphabets_in_one_block():
    rng = random.Random(8)
    texts = ["".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(0, 40))) for _ in range(500)] + ["'", "s", "'", "", "ll", "x'", "'", "re", "'s", None]
    together(Encoder(VOCABULARY, cached=300), texts)


def test_apostrophes_and_lengths_around_sixteen():
    rng = random.Random(9)
    bits = ["'", "''", "s", "t", "re", "ve", "m", "ll", "l", "d", "r", "v", " ", "!", "1", "22", "é", "“", "xylophone", "a" * 15, "a" * 16, "b" * 17, "é" * 8, "é" * 9, "c" * 70]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(1500)]
    together(Encoder(VOCABULARY, cached=500), texts)


def test_plain_signs_keep_their_bytes_in_lower_case():
    signs = [c for c in map(chr, range(0x20, 0x2100)) if tokens._PLAIN.fullmatch(c)]
    assert len(signs) > 500
    for c in signs:
        assert len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode()) and tokens._PLAIN.fullmatch(c.lower()), hex(ord(c))


def test_long_pieces_and_mixed_texts(monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 1000)
    enc = Encoder(VOCABULARY)
    for text in ("x" * 5000, "ab1" * 3000, " ".join(ALPHABETS) * 3, "It's we'LL Don'T'd 'RE", "", " \n\t", "Some words, it's 22 more. " * 900, "y" * 3000 + " z " * 2000):
        for _ in range(2):
            assert enc.encode(text) == ids(text)
        together(enc, [text, "end"])


ROWS = [(5, "Hello world"), (3, None), (9, ""), (1, "a " * 30_000), (5, "Hello world"), (7, "naïve café “x”"), (None, "no id")]


def test_store_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, part string, start int")
    path = token_store.write_tokens(docs, end_id=1)
    got = token_store.with_starts(token_store.read_tokens(spark, path)).orderBy("start").collect()
    want = [ids(t) + [1] for _, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert [r.doc_id for r in got] == [None, 1, 3, 5, 5, 7, 9]
    assert [list(r.ids) for r in got] == want
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([len(w) for w in want])[:-1])).tolist()
    sums = {r.start: r for r in token_store.checksums(token_store.with_starts(token_store.read_tokens(spark, path))).collect()}
    for r, w in zip(got, want, strict=True):
        assert (sums[r.start].n_tokens, sums[r.start].ids_crc32) == (len(w), zlib.crc32(np.array(w, "<u4").tobytes()))


def test_store_reads_only_what_is_asked(spark):
    path = token_store.write_tokens(spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string"))
    plan = token_store.read_tokens(spark, path).where("doc_id = 7").select("n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan
    assert "ids" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_store_layout(spark):
    import glob

    import pyarrow.parquet as pq

    path = token_store.write_tokens(spark.range(300).selectExpr("id AS doc_id", "repeat('some words here ', 20) AS text"), row_group_bytes=1 << 20)
    for f in glob.glob(path.removeprefix("file://") + "/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        column = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert all(c.has_offset_index for c in column.values())
        assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings
        assert any("DICTIONARY" in e for p, c in column.items() if p.startswith("ids") for e in c.encodings)


def test_store_of_nothing(spark):
    path = token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"))
    assert token_store.checksums(token_store.with_starts(token_store.read_tokens(spark, path))).count() == 0


SF = "/root/testdata/sf0.01"


def test_registered_queries_against_the_library(spark):
    """Every document's ids, checksums and places as the library alone gives them."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    raw = {i: ids(t) for i, t in texts.items()}
    start, want = 0, {}
    for i in sorted(texts):
        own = [*raw[i], 1]
        want[i] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_store(spark, SF).collect()} == want
    pieces = {}
    for i in texts:
        own = [*raw[i], 0]
        for lo in range(0, len(own), 2048):
            part = np.array(own[lo : lo + 2048], "<u4").tobytes()
            pieces[i, lo // 2048] = (lo, len(part) // 4, zlib.crc32(part))
    got = queries.op10_packing(spark, SF).collect()
    assert len(got) == len(pieces) and {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces


def test_many_long_texts_in_one_batch(spark):
    docs = spark.range(300, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('long text ', id, ' '), 70000) AS text")
    n = {r.doc_id: r.n_tokens for r in token_store.read_tokens(spark, token_store.write_tokens(docs)).select("doc_id", "n_tokens").collect()}
    one = {k: len(ids(f"long text {k} ")) * 70_000 + 1 for k in (0, 7, 299)}
    assert len(n) == 300 and {k: n[k] for k in one} == one


def test_repeated_rows_are_spread(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) AS doc_id", "'' AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = token_store.read_tokens(spark, token_store.write_tokens(docs)).groupBy("part").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in parts) == 4000 and max(r["count"] for r in parts) < 2000
    assert packing.pack_documents(docs, rows_per_task=500).groupBy((F.col("sequence_id") / 2**40).cast("int").alias("t")).count().count() > 4


def test_best_fit_takes_the_tightest_bin():
    fit = packing.BestFit(10, 8)
    assert [fit.place(n) for n in (7, 6, 3, 4, 10, 1)] == [(0, 0), (1, 0), (0, 7), (1, 6), (2, 0), (3, 0)]


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    fit.place(9)
    fit.place(5)
    fit.place(6)  # the bin of 9 closes
    assert fit.place(1) == (2, 6)


def test_best_fit_against_brute_force():
    rng, fit, bins = random.Random(3), packing.BestFit(50, 6), {}
    for opened in range(2000):
        n = rng.randint(1, 50)
        fits = [(50 - u, b) for b, u in bins.items() if 50 - u >= n]
        number, offset = fit.place(n)
        if fits:
            assert 50 - offset == min(fits)[0]
        else:
            assert offset == 0
            if n < 50 and len(bins) >= 6:
                least = max(bins.values())
                closed = [b for b, u in bins.items() if u == least]
                open_now = {b for s in fit._by_free for b in s}
                bins = {b: u for b, u in bins.items() if b in open_now}
                assert len([b for b in closed if b not in open_now]) == 1
        bins[number] = offset + n
        if bins[number] == 50:
            del bins[number]


def test_packing_is_whole_and_gapless(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, piece int")
    got = [r.asDict() for r in packing.pack_documents(docs, size=64).collect()]
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 64
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    long = sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["piece"])
    assert sum((r["ids"] for r in long), []) == [*ids("a " * 30_000), 0]
    assert [r["length"] for r in long[:-1]] == [64] * (len(long) - 1)
    assert sum(r["length"] for r in got) == sum(len(ids(t)) + 1 for _, t in ROWS)
    assert packing.pack_documents(docs.limit(0), size=64).count() == 0
