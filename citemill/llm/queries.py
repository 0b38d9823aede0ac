"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_groups
from .hard_negatives import mine_hard_negatives
from .language_id import identify
from .license_scan import scan_licenses
from .line_dedup import drop_boilerplate
from .manifest import manifest
from .mixing import taken_words
from .packing import pack
from .pii import find_personal_data
from .quality import judge
from .quotations import link_quotations
from .simhash import near_groups
from .vector_dedup import near_vectors


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(table(spark, sf_dir, "pages"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)
"""

OP5_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', '', 'g'),
           '(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|section|article|header|footer|nav|aside|main|title|head|body|html|pre|blockquote|hr|form|option)\b[^<>]*>', chr(10), 'g'),
           '<[^<>]*>', '', 'g') AS body
  FROM pages),
l AS (
  SELECT page_id, host, list_filter(list_transform(regexp_split_to_array(body, '[\r\n]+'),
    lambda x: trim(regexp_replace(x, '[ \t\x0B\f]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM p),
n AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY ALL),
t AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
c AS (SELECT host, list(line) AS gone FROM n JOIN t USING (host) WHERE host <> '' AND n >= 3 AND n > 0.3 * pages GROUP BY host),
k AS (SELECT page_id, l.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM l LEFT JOIN c ON l.host = c.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM k
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src
  FROM d GROUP BY source),
c AS (SELECT *, [3.0, 1.0, 2.0][src % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
t AS (
  SELECT src, source, source_size,
         least(cap, coalesce((SELECT arg_min(level, (cap / w, src)) FROM l WHERE level * w <= cap) * w, cap)) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.src, t.source_size, t.target, round(t.target)::BIGINT AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY t.src ORDER BY md5(d.doc_id::VARCHAR)
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
w AS (SELECT (1.5::DOUBLE * sum(source_size) / 1024 * 1.02::DOUBLE)::DOUBLE AS w FROM s),
n AS (SELECT CASE WHEN w IS NULL THEN 64 ELSE floor(w)::BIGINT + 64 END AS slots FROM w),
h AS (SELECT src, target, sum(target) OVER (ORDER BY src ROWS UNBOUNDED PRECEDING) / (SELECT sum(target) FROM t) AS high FROM t),
b AS (SELECT src, target, high, coalesce(lag(high) OVER (ORDER BY src), 0) AS low FROM h),
i AS (SELECT unnest(range((SELECT slots FROM n))) AS slot),
x AS (SELECT slot, slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE) AS x FROM i),
r AS (SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS nth FROM x JOIN b ON target >= 0.5 AND x >= low AND x < high)
SELECT p.doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0
             ELSE goal // source_size * size + least(size, greatest(0, goal % source_size - before)) END)::BIGINT AS taken,
       CASE WHEN size > 0 AND before < goal THEN coalesce(slot, (SELECT slots FROM n) + before // 1024) END::BIGINT AS first_slot
FROM p LEFT JOIN r ON r.src = p.src AND r.nth = p.before // 1024
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM w) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM t, (SELECT unnest(range(8)) AS j) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]')))::BIGINT AS n_lettered,
         len(regexp_extract_all(text, '[0-9]'))::BIGINT AS n_digits,
         coalesce(list_max(list_transform(list_filter(words, lambda x: strlen(x) > 1000), lambda x: length(x))), 0)::BIGINT AS longest_word,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}]')))::BIGINT AS n_bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')))::BIGINT AS n_cut_off
  FROM d LEFT JOIN c USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * word_chars < 5 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_lettered < 7 * n_words THEN 64 ELSE 0 END + CASE WHEN 4 * n_digits > word_chars THEN 128 ELSE 0 END
    + CASE WHEN 10 * n_bullets > 9 * n_lines THEN 256 ELSE 0 END + CASE WHEN 10 * n_cut_off > 3 * n_lines THEN 512 ELSE 0 END
    + CASE WHEN longest_word > 1000 THEN 1024 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits & 2047 = 0 AS kept, '3' AS policy FROM b
"""
OP12_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0),
s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.uid AS other, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM r a JOIN r b ON a.uid <> b.uid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT uid, anchor_id, other, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id, other) AS nth
  FROM s WHERE same QUALIFY nth <= 5),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.uid, p.other ORDER BY score DESC, vec_id, s.other) AS rank
  FROM p JOIN s ON s.uid = p.uid AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
  QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
"""

OP13_SQL = """
WITH RECURSIVE
k AS (SELECT list(c ORDER BY i) AS k FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(i))),
d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS before,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, b: xor(k[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS chosen
  FROM documents, k),
l AS (
  SELECT r, doc_id, g, sha256(before || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(before || coalesce(CASE WHEN chosen THEN strlen(lowered) || ':' || lowered ELSE strlen(text) || ':' || text END, '-')) AS tampered
  FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n AS (
  SELECT g, 0 AS level, pos, leaf AS node FROM p
  UNION ALL
  SELECT g, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS width FROM n) WHERE width > 1 GROUP BY g, level, pos // 8),
s AS (SELECT g, arg_max(node, level) AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM n GROUP BY g),
m AS (
  SELECT 0 AS level, pos, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS width FROM m) WHERE width > 1 GROUP BY level, pos // 8),
runs AS (
  SELECT g, level, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM n GROUP BY ALL
  UNION ALL
  SELECT NULL, level + 100, pos // 8, list(node ORDER BY pos) FROM m GROUP BY ALL),
segments AS (
  SELECT p.r, row_number() OVER (PARTITION BY p.r ORDER BY level) AS step,
         array_to_string(nodes[:place], '') AS before, array_to_string(nodes[place + 2:], '') AS after
  FROM p JOIN s USING (g) JOIN (SELECT *, (8 ** (level % 100))::BIGINT AS width FROM runs) t
    ON (t.g = p.g AND t.run = p.pos // (8 * width)) OR (t.g IS NULL AND t.run = s.pos // (8 * width)),
    LATERAL (SELECT CASE WHEN t.g IS NULL THEN s.pos ELSE p.pos END // width % 8 AS place)
  WHERE level < CASE WHEN t.g IS NULL THEN (SELECT max(level) + 100 FROM m) ELSE (SELECT max(level) FROM n x WHERE x.g = p.g) END),
f AS (
  SELECT r, 0::BIGINT AS step, tampered AS node FROM p
  UNION ALL
  SELECT f.r, f.step + 1, sha256(before || node || after) FROM f JOIN segments t ON t.r = f.r AND t.step = f.step + 1),
q AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM segments GROUP BY r),
e AS (SELECT r, arg_max(node, step) AS folded FROM f GROUP BY r)
SELECT doc_id, leaf, subroot, (SELECT arg_max(node, level) FROM m) AS root,
       coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = (SELECT arg_max(node, level) FROM m) AS verified
FROM p JOIN s USING (g) JOIN e USING (r) LEFT JOIN q USING (r)
"""


QUERIES = (
    op1_license_scan,
    op2_vector_dedup,
    op3_exact_dedup,
    op4_quotation_links,
    op5_line_dedup,
    op6_personal_data,
    op7_curve_packing,
    op8_simhash_groups,
    op9_language_id,
    op10_source_mix,
    op11_rule_ledger,
    op12_hard_negatives,
    op13_merkle_manifest,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op5_line_dedup": OP5_SQL, "op10_source_mix": OP10_SQL, "op11_rule_ledger": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
