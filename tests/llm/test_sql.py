"""Queries whose rows SQL gives as well, and licenses and shards on odd rows."""

import hashlib
import re
import textwrap

import pytest

from curatrix.llm import licenses, queries, sharding
from tests.compare import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert rows_of(queries.queries()[name](spark, SF)) == rows_of_sql(connect(SF), queries.oracle_sql()[name])


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_licenses_on_odd_rows(spark):
    texts = ["", None, "MIT License", "the mit\nlicense mit-license", "x " * 70_000 + "General  public,license", "mit licenses", "éMIT license", "all rights reserved", "All rights", "Apache license\napache license mit license", "İ MIT license", "licensed under the gnu general public license"]
    rows = [(k, t, "x", 0.5) for k, t in enumerate(texts)] + [(3, texts[3], "x", 0.5), (None, texts[2], "x", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[2] if r.doc_id is None else texts[r.doc_id]
        w = WORD.findall(lower(text or ""))
        places = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in licenses.PHRASES}
        starts = sorted(sum(places.values(), []))
        assert (r.n_words, r.n_base) == (len(w), len(starts)), r
        assert (r.first_word, r.last_word) == ((starts[0], starts[-1]) if starts else (None, None)), r
        assert r.base_labels == ",".join(sorted(v for p, v in licenses.PHRASES.items() if places[p]))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert [r.labels for r in got if r.doc_id == 7] == ["reserved"]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_filters_lose_no_match(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.block, r.template) for r in licenses.block_matches(docs, threshold=0.6).collect()}
    want = set()
    rows = licenses.template_rows(licenses.TEMPLATES, 0.6)
    for r in docs.select("doc_id", "text").collect():
        for block, line in enumerate((r.text or "").split("\n")):
            words = set(WORD.findall(lower(line)))
            want |= {(r.doc_id, block, k) for k, _, tokens, need in rows if len(words & set(tokens)) >= need}
    assert got == want and want


def trie(rows, limit):
    """Extendible hashing by hand: depth and prefix of each row."""
    h = [int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:8], 16) for k, _ in rows]
    out = {}

    def split(ids, depth, prefix):
        if sum(rows[i][1] for i in ids) <= limit or depth == 32:
            out.update({i: (depth, prefix) for i in ids})
            return
        for bit in (0, 1):
            split([i for i in ids if (h[i] >> (31 - depth)) & 1 == bit], depth + 1, prefix * 2 + bit)

    split(list(range(len(rows))), 0, 0)
    return out


@pytest.mark.parametrize("fine_bits", [None, 1, 3])
def test_shards_by_hand(spark, fine_bits):
    rows = [(k, (k * 37) % 101) for k in range(400)] + [(7, 900), (None, 5)]
    df = spark.createDataFrame([(k, b, n) for n, (k, b) in enumerate(rows)], "doc_id long, b long, n int")
    got = sharding.shard(df, size=df.b, limit=1000, fine_bits=fine_bits).collect()
    want = trie(rows, 1000)
    assert {r.n: (r.shard_depth, r.shard_prefix) for r in got} == want
    assert all(r.shard_bytes <= 1000 for r in got)


def test_one_hot_key(spark):
    df = spark.createDataFrame([(1, 10) for _ in range(500)] + [(1, 95), (2, 10), (1, 300)], "doc_id long, b long").repartition(4)
    got = sharding.shard(df, size=df.b, limit=100).collect()
    sums = {}
    for r in got:
        sums.setdefault((r.shard_depth, r.shard_prefix, r.shard_chunk), []).append(r.b)
    assert len(got) == 503
    assert all(sum(b) <= 100 or len(b) == 1 for b in sums.values())
    assert all(sum(sums[r.shard_depth, r.shard_prefix, r.shard_chunk]) == r.shard_bytes for r in got)


def test_shards_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, None, 9), (1, "", 9), (2, "ab", 9)], "doc_id long, text string, shard_depth int")
    got = sharding.shard(df, limit=1)
    assert got.count() == 3 and got.columns.count("shard_depth") == 1
    assert sharding.shard(df.limit(0)).count() == 0


def test_shards_with_clashing_names(spark):
    names = ["_h", "_b", "_c", "_p", "_s", "_o", "cell", "bytes", "depth", "prefix", "_shard_x", "shard_bytes"]
    rows = [(k % 5, 10 + k % 3, *[k] * len(names)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, b long, " + ", ".join(f"`{n}` long" for n in names)).repartition(3)
    got = sharding.shard(df, size=df.b, limit=200)
    assert got.columns == ["doc_id", "b", *names[:-1], "shard_depth", "shard_prefix", "shard_chunk", "shard_bytes"]
    sums = {}
    for r in got.collect():
        sums.setdefault((r.shard_depth, r.shard_prefix, r.shard_chunk), []).append(r)
    assert sorted(r._h for x in sums.values() for r in x) == list(range(600))
    assert all(sum(r.b for r in x) == x[0].shard_bytes <= 200 for x in sums.values())


def test_each_notice_has_its_own_label(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    wrap = lambda text, width, mark="": "\n".join(mark + x for x in textwrap.wrap(text, width))
    cases = [(text, {label}) for label, text in licenses.TEMPLATES]
    cases += [
        ("Licensed under the Apache License, Version 2.0.", {"apache-notice"}), ("This work is licensed under the GNU General Public License, version 3.", {"gpl-notice"}), ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}), ("Licensed under CC BY 4.0.", {"cc-by"}), ("Licensed under CC BY-SA 4.0.", {"cc-by-sa"}),
        ("Licensed under the Foo License", set()), ("This work is licensed under the Mozilla Public License version 3", set()), ("Licensed under CC BY 4.0, pictures licensed under CC BY-NC 4.0", {"cc-by", "cc-by-nc"}),
        ("Licensed under the Apache License\nMIT is a place", set()), ("Released under\nthe MIT\nLicense", {"mit-notice"}),
    ]
    for width in (20, 40, 72):
        for mark in ("", " * ", "# "):
            cases += [(wrap(grant, width, mark), {"mit-grant"}), (f"Some words.\n\n{wrap(bsd, width, mark)}\n* x\n", {"bsd-terms"}), (wrap(gpl, width, mark) + "\n\nend", {"gpl-terms"})]
    cases += [(wrap(" ".join(w for x in grant.split() for w in (x, *["word"] * 9)), 60), set())]
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) - set(r.base_labels.split(",")) for r in licenses.scan_notices(docs).collect()}
    assert got == {k: w for k, (_, w) in enumerate(cases)}, [(cases[k], got[k]) for k in got if got[k] != cases[k][1]]
    assert licenses.scan_notices(docs.limit(0)).count() == 0
