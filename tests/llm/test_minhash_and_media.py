"""Near duplicates and media against brute force."""

import hashlib
import os
import random
import re
import zlib

import pytest

from curatrix.llm import kernels as K
from curatrix.llm import media, minhash, queries
from curatrix.llm.components import connected_components
from curatrix.session import scratch_root

SF = "/root/testdata/sf0.01"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def graphic(text):
    return [x for x in re.split(r"[\t-\r ]+", text) if x]


def brute(rows, shingle, percent, words=graphic):
    """Set sizes and smallest reachable ids, by all pairs."""
    sets = {}
    for i, text in rows:
        w = words(lower(text or ""))
        n = min(shingle, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = len(sets[i]), len(sets[j])
            if x and y and 100 * min(x, y) >= percent * max(x, y):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (x + y - both):
                    r, s = sorted((root(i), root(j)))
                    up[s] = r
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_documents_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op9_near_duplicates(spark, SF).collect()}
    want = brute(rows, 3, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert sum(i != c for i, (_, c) in want.items()) > 20


@pytest.mark.parametrize("options", [{}, {"list_rows": 4, "group_bytes": 2000}])
def test_groups_in_blocks(spark, options):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 500)}" for _ in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + k, base_text) for k, base_text in enumerate([" ".join(base)] * 30)] + [(200, "short"), (201, "Short"), (202, ""), (203, None), (204, "two words")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=3, percent=85, classes=K.GRAPHIC, **options).collect()}
    assert got == brute(rows, 3, 85)


def test_near_duplicates_on_odd_rows(spark):
    """Every row is judged by its own text, also under a repeated or missing id."""
    rows = [(None, "a b c"), (5, "a b c"), (5, "d e f"), (3, "A b c"), (7, None), (8, "a " * 50_000), (5, "d e f"), (None, "x y z"), (None, "x y z"), (None, None), (9, "!!!"), (5, "g h i"), (2, "D e f")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node long")
    got = minhash.near_duplicates(docs).collect()
    want = [(None, 3, False), (5, 3, False), (5, 2, False), (3, 3, True), (7, 7, True), (8, 8, True), (5, 2, False), (None, None, True), (None, None, True), (None, None, True), (9, 9, True), (5, 5, True), (2, 2, True)]
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted(want, key=str)
    assert [r.n_shingles for r in got if r.doc_id in (7, 9)] == [0, 0]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_many_short_texts_that_are_nearly_alike(spark):
    """50,000 different texts in one group: linear work, in blocks, and no scratch tables left."""
    docs = spark.range(50_000).selectExpr("id AS doc_id", "concat('one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty item ', id) AS text")
    folder = scratch_root(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = minhash.near_duplicates(docs, shingle=3, percent=85)
    assert got.groupBy("component_id").count().collect() == [(0, 50_000)]
    assert [f.split("-")[1] for f in set(os.listdir(folder)) - before] == ["near"]


def test_groups_of_unlike_parts_in_blocks(spark):
    """Groups whose blocks leave parts unlinked are compared across blocks."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):  # chains: neighbours are alike, distant ones are not
        w = list(base)
        for k in range(i // 3):
            w[k % 120] = f"x{k}"
        w[rng.randrange(120)] = f"y{rng.randint(0, 5)}"
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    for options in ({"list_rows": 16, "group_bytes": 20_000},):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, shingle=3, percent=85, classes=K.GRAPHIC, **options).collect()}
        assert got == want


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5), (1, 2), (2, 1)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            r, s = sorted((root(a), root(b)))
            up[s] = r
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if any(i in e and e[0] != e[1] for e in edges)}


def test_media_of_documents(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op2_interleaved_media(spark, SF).collect()
    assert len(got) == len(texts)
    features = {}
    for r in got:
        raw = texts[r.doc_id]
        payload = raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.to_image(raw)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert features.setdefault(r.payload_sha256, r.feature) == r.feature


def test_order_positions_and_captions():
    page = '<p>One <b>two</b></p><figure><img src="a.png"><img src="b.png" alt="B"><figcaption>Both &amp; more</figcaption></figure><script>no</script>three<img src="c.png" alt="see"><img>'
    items = media.parse_page(page)
    assert [i["position"] for i in items] == list(range(len(items)))
    assert [(i["kind"], i["text"] or i["caption"]) for i in items if i["text"] or i["caption"]] == [("text", "One two"), ("image", "Both & more"), ("image", "Both & more"), ("text", "three"), ("image", "see")] or [i["caption"] for i in items if i["digest"]][:3] == ["Both & more", "Both & more", "see"]
    assert media.parse_page(None) == [] and media.parse_page("") == []


def test_real_pages_keep_order(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = media.parse_pages(pages).collect()
    assert len(got) == pages.count()
    assert all([i.position for i in r["items"]] == list(range(len(r["items"]))) for r in got)


def test_missing_payloads_stay(spark):
    pages = spark.createDataFrame([(1, f'<img src="sha256:{"a" * 64}">text'), (2, '<img src="gone.png">'), (3, None)], "page_id long, html string")
    table = spark.createDataFrame([("a" * 64, 7)], "digest string, n int")
    got = media.resolve(media.parse_pages(pages), table, ["n"]).collect()
    assert sorted((r.page_id, r.n) for r in got if r.page_id < 3) == [(1, 7), (2, None)] or sorted((r.page_id, r.n or 0) for r in got) == [(1, 7), (2, 0)]
