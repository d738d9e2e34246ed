"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html_text, media, mixing, pii, sharding, simhash, simple8b, toxicity, warc
from .work import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return simple8b.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), sharding.layout(16), sharding.layout(17))


def op10_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_contextual_pii, op3_mixing_curriculum, op4_simple8b_tokens, op5_toxicity, op6_line_block_text, op7_benchmark_decontamination, op8_warc_index, op9_hash_tree_sharding, op10_png_media)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(cast(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
n AS (SELECT item, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM n)),
sizes AS (SELECT DISTINCT size FROM n),
windows AS (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, size, item FROM windows JOIN grams USING (size, g)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""

_CAPTURES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
last AS (SELECT html, max(page_id) AS latest FROM p GROUP BY html)
SELECT page_id, cast(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(sha, 1 + 5 * (i // 4), 5) AS INTEGER) >> (5 * (3 - i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> latest THEN latest END AS refers_to
FROM p JOIN last USING (html)"""

_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  cast('0x' || substr(md5(coalesce(cast(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + place % 3]::DOUBLE AS weight, source_size * 3::DOUBLE AS cap, [-0.5, 0.0, 0.5][1 + place % 3]::DOUBLE AS slope FROM s),
f AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER ahead, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0) AS weight_left
  FROM w WINDOW ahead AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(words_left / weight_left, (cap / weight, place)) AS level FROM f WHERE cap > words_left / weight_left * weight),
t AS (SELECT source, source_size, slope, least(cap, coalesce(level * weight, cap)) AS target FROM f, l),
o AS (SELECT d.*, source_size, slope, target, round(target)::BIGINT AS goal,
  cast(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, [goal - before, goal - source_size - before, goal - 2 * source_size - before] AS ends, [least(1.0, (before + n * source_size) / target) FOR n IN [0, 1, 2]] AS shares FROM o),
r AS (SELECT *, list_transform(list_filter([0, 1, 2], lambda n: target > 0 AND least(size, ends[n + 1]) > 0),
  lambda n: CASE WHEN slope = 0 THEN shares[n + 1] ELSE abs((1 - slope - sqrt(greatest((1 - slope) * (1 - slope) - 4 * -slope * shares[n + 1], 0))) / (2 * -slope)) END) AS positions FROM p)
SELECT doc_id, cast(size AS BIGINT) AS size, source_size, target, cast(list_sum([greatest(0, least(size, e)) FOR e IN ends]) AS BIGINT) AS taken,
  cast(list_sum([CASE WHEN 2 * e > size THEN 1 ELSE 0 END FOR e IN ends]) AS INTEGER) AS copies, positions[1] AS position, positions FROM r"""

ORACLE_SQL: dict[str, str] = {"op3_mixing_curriculum": _MIX, "op7_benchmark_decontamination": _DECONTAMINATION, "op8_warc_index": _CAPTURES}
