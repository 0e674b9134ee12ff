"""License detection by an exact set-similarity join of text blocks with templates.

Only DataFrame functions run here.  A block is a line; its tokens and a
template's tokens are sets of lower-case words.  A block matches a template if
it contains at least ``threshold`` of the template's tokens.

Tokens are ordered by their document frequency over the whole corpus, rarest
first.  A match must share one of the first ``|T| - need + 1`` tokens of the
template (prefix filter), must have at least ``need`` tokens (length filter),
and, if the first shared token is the template's i-th, the template's remaining
tokens must still reach ``need`` (positional filter).  What passes is compared
in full, so the filters cost no match.

The prefix index is built from the templates, a list given by the caller; its
size is checked before it is broadcast, and beyond the limit Spark chooses a
shuffled join.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Positive classes and possessive repetition: the negated class takes five times as long.
LETTERS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORD = f"[{LETTERS}]++"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices by label, in the wording under which works are commonly released.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-terms", "you may not use this file except in compliance with the license"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-terms", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd-terms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("reserved", "all rights reserved"),
]
THRESHOLD = 0.8
#: Templates of up to so many different words are short: all of them must stand in a block.
SHORT_WORDS = 8
#: Words that tell notices apart; a template's must all stand in a block.
NAMES = frozenset({"mit", "apache", "gnu", "general", "cc", "sa", "nc"})
BROADCAST_ROWS = 100_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _tokens(text: Column) -> Column:
    """Distinct lower-case words; lower() may also change non-ASCII letters, which no template has."""
    return F.array_remove(F.array_distinct(F.split(ascii_lower(text), GAP)), "")


def template_rows(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, str, list[str], int]]:
    """Number, label, tokens and needed overlap of each template; empty ones are refused."""
    rows = []
    for k, (label, text) in enumerate(templates):
        tokens = sorted({w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)})
        if not tokens:
            raise ValueError(f"template {label!r} has no words")
        rows.append((k, label, tokens, max(1, math.ceil(threshold * len(tokens) - 1e-9))))
    return rows


def _any_word(words: list[str]) -> str:
    """Pattern of a word of ``words``, in either case for A to Z; words are letters and digits, so they need no escapes."""
    return rf"(?i)(?<![{LETTERS}])(?:{'|'.join(words)})(?![{LETTERS}])"


def document_frequency(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word of ``vocabulary`` (the templates' words) occurs."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    counted = docs.select(F.explode(F.array_intersect(F.split(F.lower("text"), GAP), words)).alias("w")).groupBy("w").count()
    return {r[0]: r[1] for r in counted.collect()}  # at most one row for each template word


def block_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every matching pair of a block and a template: ``keep`` columns, ``block, template, label, score``.

    ``block`` numbers a text's lines from 0; ``score`` is the contained share of
    the template.  Null and empty texts have no blocks.
    """
    spark = docs.sparkSession
    rows = template_rows(templates, threshold)
    vocabulary = sorted({w for r in rows for w in r[2]})
    freq = document_frequency(docs, vocabulary)
    entries = []
    for k, label, tokens, need in rows:
        ordered = sorted(tokens, key=lambda w: (freq.get(w, 0), w))
        entries += [(w, k, label, ordered, need, len(ordered) - i) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("need", T.IntegerType()), T.StructField("left", T.IntegerType())])
    index = spark.createDataFrame(entries, schema)
    if len(entries) <= BROADCAST_ROWS:
        index = F.broadcast(index)
    heads = sorted({e[0] for e in entries})
    shortest = min(r[3] for r in rows)
    # The prefix filter as a scan over the raw text comes first: most lines have no head token at all.
    head_pattern = _any_word(heads)
    lines = docs.where(F.col("text").rlike(head_pattern)).select(*keep, F.posexplode(F.split("text", "\n")).alias("block", "_line")).where(F.col("_line").rlike(head_pattern))
    sets = lines.select(*keep, "block", _tokens(F.col("_line")).alias("_words")).where(F.size("_words") >= shortest)
    probes = sets.select(*keep, "block", "_words", F.explode(F.array_intersect("_words", F.array(*[F.lit(w) for w in heads]))).alias("token"))
    both = F.size(F.array_intersect("_words", "tokens"))
    # A pair is met once for each shared head token; only its first one in the order counts.
    first = F.expr("element_at(array_intersect(tokens, _words), 1)") == F.col("token")
    hits = probes.join(index, "token").where((F.size("_words") >= F.col("need")) & (F.col("left") >= F.col("need"))).where(first).withColumn("_both", both).where(F.col("_both") >= F.col("need"))
    return hits.select(*keep, "block", "template", "label", (F.col("_both") / F.size("tokens")).alias("score"))


def notice_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Pairs of a text and a template that tell licenses apart: ``keep`` columns, ``label, score``.

    Blocks are single lines, and paragraphs of several lines, so a wrapped notice
    is found.  A short template needs all its words, a long one ``threshold`` of
    them with all its ``NAMES``.  In a paragraph a short template must stand word
    by word, and a long one within a stretch of twice its length.  A template
    whose words another matching template of the block includes, as CC BY those of
    CC BY-NC, counts only if it stands word by word.
    """
    spark = docs.sparkSession
    entries = []
    for k, label, tokens, need in template_rows(templates, threshold):
        text = next(t for n, (_, t) in enumerate(templates) if n == k).lower()
        short = len(tokens) <= SHORT_WORDS
        must = tokens if short else sorted(NAMES & set(tokens))
        entries.append((k, label, tokens, must, len(tokens) if short else need, short, f" {' '.join(text.split())} ", 2 * len(text.split())))
    freq = document_frequency(docs, sorted({w for e in entries for w in e[2]}))
    # A block that matches has one of these words of the template: all but need - 1, the rarest.
    heads = {e[0]: sorted(e[2], key=lambda w: (freq.get(w, 0), w))[: len(e[2]) - e[4] + 1] for e in entries}
    pattern = _any_word(sorted({w for h in heads.values() for w in h}))
    one = docs.where(F.col("text").rlike(pattern))
    lines = one.select(*keep, F.lit(False).alias("_wrapped"), F.posexplode(F.split("text", "\n")).alias("block", "_text"))
    paragraphs = one.where(F.col("text").contains("\n")).select(*keep, F.lit(True).alias("_wrapped"), F.posexplode(F.split("text", r"\n(?:[ \t\r\x0B\f]*\n)+")).alias("block", "_text"))
    blocks = lines.unionByName(paragraphs.where(F.col("_text").contains("\n"))).where(F.col("_text").rlike(pattern))
    words = blocks.withColumn("_words", F.array_remove(F.split(ascii_lower(F.col("_text")), GAP), "")).withColumn("_set", F.array_distinct("_words"))
    schema = "template int, label string, tokens array<string>, must array<string>, need int, short boolean, phrase string, span int, token string"
    index = spark.createDataFrame([(*e, w) for e in entries for w in heads[e[0]]], schema)
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    probes = words.select(*keep, "_wrapped", "block", "_words", "_set", F.explode(F.array_intersect("_set", F.array(*[F.lit(w) for w in sorted({w for h in heads.values() for w in h})]))).alias("token"))
    both = F.size(F.array_intersect("tokens", "_set"))
    rarest = F.array(*[F.lit(w) for w in sorted({w for e in entries for w in e[2]}, key=lambda w: (freq.get(w, 0), w))])
    # A pair is met once for each shared head word; only the rarest shared word counts.
    first = F.expr("element_at(_order, 1)") == F.col("token")
    hits = probes.join(index, "token").where(F.size(F.array_except("must", "_set")) == 0).withColumn("_both", both).where(F.col("_both") >= F.col("need"))
    hits = hits.withColumn("_order", F.array_intersect(rarest, F.array_intersect("tokens", "_set"))).where(first)
    literal = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).contains(F.col("phrase"))
    at = F.sequence(F.lit(1), F.greatest(F.size("_words") - F.col("span") + 1, F.lit(1)))

    def dense(i: Column) -> Column:
        near = F.slice("_words", i, F.col("span"))
        return (F.size(F.array_intersect("tokens", near)) >= F.col("need")) & (F.size(F.array_except("must", near)) == 0)

    stands = F.when(~F.col("_wrapped"), True).when(F.col("short"), F.col("_literal")).otherwise(F.exists(at, dense))
    hits = hits.withColumn("_literal", literal).where(stands)
    found = F.struct("template", "label", "tokens", "_literal", (F.col("_both") / F.size("tokens")).alias("score"))
    grouped = hits.groupBy(*keep, "_wrapped", "block").agg(F.collect_list(found).alias("_found"))  # at most one for each template
    included = F.expr("exists(_found, y -> size(y.tokens) > size(x.tokens) and size(array_except(x.tokens, y.tokens)) = 0)")
    own = grouped.select(*keep, F.explode("_found").alias("x"), "_found").where(F.col("x._literal") | ~included)
    return own.select(*keep, "x.label", "x.score")


def scan_notices(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``scan_licenses`` with the labels of ``notice_matches``: each notice its own, wrapped ones too."""
    return scan_licenses(docs, templates, threshold, notice_matches)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, matches: Callable[..., DataFrame] = block_matches) -> DataFrame:
    """One row for each row of ``docs``: base phrases, template labels and a score.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.
    Null texts count as empty: no words, no labels (empty strings), null places,
    score 0.  Repeated rows get a result each; other columns are ignored.  The
    score is 1 where a base phrase stands, else the best template's containment.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    row_key = F.xxhash64("text")
    found = matches(rows.withColumn("_k", row_key), templates, threshold, ("doc_id", "_k")).groupBy("doc_id", "_k").agg(F.collect_set("label").alias("_labels"), F.max("score").alias("_score"))
    with_base = F.col("text").rlike("(?i)license")
    norm = F.when(with_base, F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.col("text")), GAP, " ")), F.lit(" ")))
    ahead = " (?=" + "|".join(f"{p} " for p in PHRASES) + ")"
    words_in = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    base = (
        rows.select("doc_id", row_key.alias("_k"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"), norm.alias("_norm"))
        .withColumn("_parts", F.when(F.col("_norm").isNotNull(), F.split("_norm", ahead, -1)))
        .withColumn("n_base", F.coalesce(F.size("_parts") - 1, F.lit(0)).cast("long"))
        .withColumn("n_base", F.greatest("n_base", F.lit(0).cast("long")))
        .withColumn("first_word", F.when(F.col("n_base") > 0, words_in(F.element_at("_parts", 1))).cast("long"))
        .withColumn("last_word", F.when(F.col("n_base") > 0, F.col("n_words") - words_in(F.element_at("_parts", -1))).cast("long"))
        .withColumn("_base", F.array_compact(F.array(*[F.when(F.col("_norm").contains(f" {p} "), F.lit(v)) for p, v in PHRASES.items()])))
        .drop("_norm", "_parts")
    )
    joined = base.alias("b").join(found.alias("f"), (F.col("b.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("b._k") == F.col("f._k")), "left")
    labels = F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0)))
    return joined.select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), score.alias("score"),
    )
