"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import decontam, labelled, licenses, media, minhash, packing, quality, secrets, sharding, token_store, toxicity
from curatrix.llm import kernels as K
from curatrix.session import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write ordered token files, and read sizes and checksums back."""
    path = token_store.write_tokens(_table(spark, sf_dir, "documents"), end_id=1)
    return token_store.checksums(token_store.with_starts(token_store.read_tokens(spark, path)))


def op2_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an image that a page refers to, and resolve the references by digest."""
    stored = media.store_documents(_table(spark, sf_dir, "documents"))
    columns = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    found = media.resolve(media.parse_pages(stored, keep="doc_id"), media.describe_media(stored), columns, keep="doc_id")
    return found.select("doc_id", "n_bytes", *columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents for quality, learning from two of three folds."""
    held = labelled.fold(3) == 1
    labels = _table(spark, sf_dir, "labels").where(~held)
    scored = quality.score_quality(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents for secrets."""
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match all documents with all benchmark items."""
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents for toxicity, learning from four of five folds."""
    held = labelled.fold(5) == 0
    labels = _table(spark, sf_dir, "labels").where(~held)
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


SHARD_LIMIT = 4 << 20


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assign all documents to shards of at most 4 MiB of text."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    out = sharding.shard(rows, size=F.col("n_bytes"), limit=SHARD_LIMIT)
    return out.select("doc_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "shard_depth", "shard_prefix", "shard_chunk", "shard_bytes")


OP7_SQL = f"""
WITH h AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS b FROM documents),
levels AS (SELECT doc_id, b, d, h // (1::BIGINT << (32 - d)) AS p FROM h, range(0, 33) t(d)),
totals AS (SELECT d, p, sum(b)::BIGINT AS s FROM levels GROUP BY d, p),
fits AS (SELECT l.doc_id, l.b, l.d, l.p, t.s, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.d) AS r
         FROM levels l JOIN totals t ON l.d = t.d AND l.p = t.p WHERE t.s <= {SHARD_LIMIT} OR l.d = 32)
SELECT doc_id, b AS n_bytes, d::INTEGER AS shard_depth, p AS shard_prefix, 0::INTEGER AS shard_chunk, s AS shard_bytes FROM fits WHERE r = 1
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents for license phrases and notices by the rules of its SQL: 0.8 of a template's words in a line."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents for license phrases and notices, each notice with its own label and wrapped ones too."""
    return licenses.scan_notices(_table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    rows = licenses.template_rows(licenses.TEMPLATES, licenses.THRESHOLD)
    templates = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in tokens)}], {need})" for k, label, tokens, need in rows)
    low = f"translate({{}}, '{licenses.UPPER}', '{licenses.LOWER}')"
    words = "list_filter(string_split_regex(" + low + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    at = lambda phrase: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split(), 1))
    starts = {v: f"list_filter(range(0, len(w)), lambda i: {at(p)})" for p, v in licenses.PHRASES.items()}
    base = ", ".join(f"CASE WHEN len({s}) > 0 THEN '{v}' END" for v, s in starts.items())
    places = "list_concat(" + ", ".join(list(starts.values())[:2]) + ")"
    places = f"list_concat({places}, {list(starts.values())[2]})"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT doc_id, r, {words.format("text")} AS w FROM docs),
b AS (SELECT doc_id, r, len(w)::BIGINT AS n_words, CASE WHEN list_contains(w, 'license') THEN {places} ELSE [] END AS places,
      CASE WHEN list_contains(w, 'license') THEN list_filter([{base}], lambda x: x IS NOT NULL) ELSE [] END AS labels FROM w),
t(k, label, tokens, need) AS (VALUES {templates}),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
sets AS (SELECT r, list_distinct({words.format("line")}) AS s FROM lines),
hits AS (SELECT r, label, len(list_intersect(s, tokens)) / len(tokens)::DOUBLE AS score FROM sets, t
         WHERE len(s) >= need AND len(list_intersect(s, tokens)) >= need),
m AS (SELECT r, list(DISTINCT label) AS more, max(score) AS score FROM hits GROUP BY r)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(labels, coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN m USING (r)
"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their 3-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85, classes=K.GRAPHIC)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), end_id=0, size=2048, include_ids=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_store, op2_interleaved_media, op3_quality, op4_secrets, op5_decontamination, op6_toxicity, op7_sharding, op8_licenses, op8_license_notices, op9_near_duplicates, op10_packing, pipeline]
    return {q.__name__: _shipped(q) for q in own}


def oracle_sql() -> dict[str, str]:
    return {"op7_sharding": OP7_SQL, "op8_licenses": _op8_sql()}
