"""Registered queries of the corpus operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op5_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (
  SELECT doc_id, pos, line, coalesce(doc_id > first_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op5_line_dedup(spark, sf_dir):
    from .line_dedup import dedup_lines
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op10_simhash")
def op10_simhash(spark, sf_dir):
    from .simhash import simhash_components
    return simhash_components(documents(spark, sf_dir), shingle=3, limit=2)


@register("op4_language_id")
def op4_language_id(spark, sf_dir):
    from .lang_id import identify_languages
    return identify_languages(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


@register("op2_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h,
         min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
b AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT)) AS words FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((words[(i // 4) + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM b""")
def op2_warc(spark, sf_dir):
    from .common import scratch
    from .warc import list_archives, read_warc, write_warc
    folder = scratch(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, min_bytes=0)
    return read_warc(spark, list_archives(spark, folder), with_payload=False).select(
        F.expr("try_cast(regexp_extract(record_id, '^<urn:page:(.*)>$', 1) AS bigint)").alias("page_id"),
        "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), F.expr("try_cast(regexp_extract(refers_to, '^<urn:page:(.*)>$', 1) AS bigint)")).alias("refers_to"))


MIX_ALPHA, MIX_SEED = 0.5, 17


@register("op1_mixing", f"""
WITH v AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS volume FROM documents GROUP BY source),
r AS (
  SELECT source, CASE WHEN volume > 0 THEN pow(volume, {MIX_ALPHA}) / (SELECT sum(pow(volume, {MIX_ALPHA})) FROM v WHERE volume > 0)
         * (SELECT sum(volume) FROM v) / volume ELSE 0 END AS rate FROM v),
s AS (SELECT source, rate, CAST(greatest(1, ceil(rate / 256)) AS INTEGER) AS parts FROM r),
pmf AS (
  SELECT source, k, CASE WHEN rate > 0 THEN exp(k * ln(rate / parts) - rate / parts - lgamma(k + 1)) ELSE CAST(k = 0 AS INTEGER) END AS p
  FROM (SELECT *, unnest(range(0, CAST(ceil(rate / parts + 9 * sqrt(rate / parts) + 21) AS INTEGER))) AS k FROM s)),
cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf) GROUP BY source),
n AS (
  SELECT d.*, s.rate, CAST(list_sum(list_transform(range(1, s.parts + 1), lambda i: len(list_filter(cdf.cs, lambda c:
         c <= CAST('0x' || substr(md5('{MIX_SEED}:' || CAST(d.doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT)
              / 4503599627370496.0)))) AS INTEGER) AS copies
  FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copies, copy,
       substr(md5('{MIX_SEED}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR) || ':place'), 1, 16) AS shuffle_key
FROM (SELECT *, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM n)""")
def op1_mixing(spark, sf_dir):
    from .mixing import mix_sources
    return mix_sources(documents(spark, sf_dir), alpha=MIX_ALPHA, seed=MIX_SEED).withColumn("rate", F.round("rate", 9))


@register("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    from .token_counts import token_counts
    return token_counts(documents(spark, sf_dir))


@register("op8_lz_fingerprint")
def op8_lz_fingerprint(spark, sf_dir):
    from .lz_fingerprint import fingerprint_edits
    return fingerprint_edits(documents(spark, sf_dir))


@register("op9_spann")
def op9_spann(spark, sf_dir):
    from .spann import nearest_neighbours
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, k=10)


@register("op3_packing")
def op3_packing(spark, sf_dir):
    from .packing import pack_documents
    return pack_documents(documents(spark, sf_dir), capacity=2048, tokenizer="word_bpe_49k.json", with_ids=False)


@register("op6_substring_dedup")
def op6_substring_dedup(spark, sf_dir):
    from .substring_dedup import remove_repeated_substrings
    return remove_repeated_substrings(documents(spark, sf_dir), width=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


RESAMPLE = {"max_words": 1, "buckets": 10_000, "percent": 10, "min_words": 20, "seed": 2024}


def _features_sql(table: str) -> str:
    words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return f"SELECT *, {words} AS words FROM {table}"


@register("op11_importance_resampling", f"""
WITH RECURSIVE register AS (
  SELECT range AS byte, range AS c, 0 AS step FROM range(256)
  UNION ALL SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM register WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS images FROM register WHERE step = 8),
d AS ({_features_sql('documents')}), b AS ({_features_sql('benchmark')}),
uses AS (
  SELECT w, sum(n) AS s, sum(m) AS t FROM (
    SELECT w, count(*) AS n, 0 AS m FROM (SELECT unnest(words) AS w FROM d) GROUP BY w
    UNION ALL SELECT w, 0, count(*) FROM (SELECT unnest(words) AS w FROM b) GROUP BY w) GROUP BY w),
hashed AS (
  SELECT w, s, t, xor(4294967295, list_reduce(list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
         lambda c, x: xor(c >> 8, images[CAST((xor(c, x) & 255) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT))) % {RESAMPLE['buckets']} AS bucket
  FROM uses, crc_table),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (all_s + {RESAMPLE['buckets']}) / ((s + 1) * (all_t + {RESAMPLE['buckets']})))) AS gain
  FROM (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY bucket),
       (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM hashed)),
weights AS (
  SELECT row_id, sum(gain) AS weight FROM (SELECT rowid AS row_id, unnest(words) AS w FROM (SELECT *, row_number() OVER () AS rowid FROM d))
  JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY row_id),
scored AS (
  SELECT doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln(
         (CAST('0x' || substr(sha256('{RESAMPLE['seed']}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER () AS row_id FROM d) LEFT JOIN weights USING (row_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {RESAMPLE['min_words']} ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= {RESAMPLE['min_words']}) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= {RESAMPLE['min_words']} AND place <= able * {RESAMPLE['percent']} // 100 THEN place END AS rank FROM placed""")
def op11_importance_resampling(spark, sf_dir):
    from .target_resampling import importance_resample
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), **RESAMPLE)


@register("op12_sorted_projections")
def op12_sorted_projections(spark, sf_dir):
    from .projection_dedup import near_duplicate_vectors
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


@register("op13_whitening")
def op13_whitening(spark, sf_dir):
    from .whitening import whiten
    done = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8, scale=1024, shift=100_000)
    return done.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", "explained",
                       F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")
