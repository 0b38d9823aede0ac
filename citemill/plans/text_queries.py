"""Normalisation, chunking, corpus projections and audits over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import text as T
from citemill.operators import chunking, evidence, metrics
from citemill.sources import files

from citemill.sources.store import stored

from .tables import catalogue, table

QUERIES, SQL, register = catalogue()
CORPUS = files.CorpusConfig("docs", "abc123", ("en/", "fr/"), ("en/9",), (".md", ".mdx"), "en/", "https://docs.example.org/{path}", "https://git.example.org/{repo}/blob/{commit}/{path}")


@register(r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(text, '\*\*|`', '', 'g'), '\s+', ' ', 'g'))) AS normalized FROM documents")
def normalize_match_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.match_text(F.col("text")).alias("normalized"))


_SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z\x60\[*(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s) <> '')"


@register(f"SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)")
def sentence_split(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@register(f"""
WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents),
n AS (SELECT doc_id, list_transform(s, lambda x: {{'c': []::INT[], 'u': len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> ''))::INT}}) AS l FROM s WHERE len(s) > 0),
f AS (
  SELECT doc_id, l, list_reduce(l, lambda a, x: {{
    'c': list_append(a.c, (CASE WHEN a.u > 0 AND a.u + x.u > 256 THEN coalesce(a.c[-1], 0) + 1 ELSE coalesce(a.c[-1], 0) END)::INT),
    'u': (CASE WHEN a.u > 0 AND a.u + x.u > 256 THEN x.u ELSE a.u + x.u END)::INT}}, {{'c': []::INT[], 'u': 0::INT}}).c AS c FROM n),
e AS (SELECT f.doc_id, unnest(c) AS chunk, unnest(list_transform(l, lambda x: x.u)) AS n, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM f JOIN s ON s.doc_id = f.doc_id)
SELECT doc_id, chunk, sum(n)::BIGINT AS n_tokens, md5(string_agg(sentence, ' ' ORDER BY pos)) AS text_md5 FROM e GROUP BY 1, 2""")
def greedy_pack(spark, d):
    return chunking.pack_sentences(table(spark, d, "documents"), 256).select("doc_id", "chunk", "n_tokens", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register(r"""SELECT doc_id, len(regexp_extract_all(text, '\b\d+(?:[.,]\d+)*\s*(?:%|bps|basis points|seconds|blocks|days|wei|gwei|bits?)\b|\b0x[0-9a-fA-F]{8,}\b|\b\d{2,}\b')) AS hits
FROM documents WHERE hits >= 2""")
def numeric_sections(spark, d):
    docs = table(spark, d, "documents").where(T.has_numeric(F.col("text")))
    return docs.select("doc_id", F.regexp_count("text", F.lit(T.NUMERIC)).cast("long").alias("hits"))


@register(r"SELECT doc_id, len(w) AS n_words, array_to_string(w[1:700], ' ') AS section FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) >= 60")
def drafting_sections(spark, d):
    """Sections long enough to draft a question from, at most 700 words of each shown (a feature of the prompt).

    Only documents with a line that may be a heading, or underline one, are parsed; others are one section.
    """
    text = F.col("text")
    parsed = chunking.section_texts(F.when(F.rlike("text", F.lit(r"(?m)^[ \t]*(#|(=+|-+)[ \t]*$)")), text))
    cut = table(spark, d, "documents").select("doc_id", F.explode(F.coalesce(parsed, F.array("text"))).alias("text"))
    sections = cut.select("doc_id", T.words(text).alias("w")).where(F.size("w") >= 60)
    return sections.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join(F.slice("w", 1, 700), " ").alias("section"))


@register("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, sha256('m' || chr(0) || text) AS key, length(text) // 3 + 1 AS estimated_tokens, substr(sha256('s:' || doc_id), 1, 16) AS user_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.sha2(text.cast("binary"), 256).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"), T.embedding_key("m", text).alias("key"),
        T.estimated_tokens(text).cast("long").alias("estimated_tokens"), T.user_hash(F.col("doc_id"), "s").alias("user_hash"),
    )


@register("SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents")
def fetch_summary(spark, d):
    return files.fetch_summary(table(spark, d, "documents").select(F.octet_length("text").cast("long").alias("bytes")))


_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || ['.md', '/index.mdx', '.txt', '/index'][page_id % 4 + 1]"


@register(rf"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, path, 'https://git.example.org/docs/blob/abc123/' || path AS source_url,
       'https://docs.example.org/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '^en/', ''), '\.md$', ''), '\.mdx$', ''), '/index$', ''), 'index$', ''), '/+$', '') AS published_url
FROM p WHERE (starts_with(path, 'en/') OR starts_with(path, 'fr/')) AND NOT starts_with(path, 'en/9') AND (ends_with(path, '.md') OR ends_with(path, '.mdx'))""")
def corpus_filter_urls(spark, d):
    """Page paths under the corpus predicate, with their published and source URLs."""
    suffix = F.element_at(F.array(*map(F.lit, (".md", "/index.mdx", ".txt", "/index"))), (F.col("page_id") % 4 + 1).cast("int"))
    paths = table(spark, d, "pages").select("page_id", F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), suffix).alias("path"))
    path = F.col("path")
    return paths.where(files.wants(path, CORPUS)).select("page_id", "path", files.source_url(path, CORPUS).alias("source_url"), files.published_url(path, CORPUS).alias("published_url"))


@register("""
WITH m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 10 <> 3),
f AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 5)
SELECT coalesce(m.doc_id, f.doc_id) AS doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unlisted' ELSE 'sha256 mismatch' END AS problem
FROM m FULL JOIN f ON m.doc_id = f.doc_id WHERE f.doc_id IS NULL OR m.doc_id IS NULL OR m.h <> f.h""")
def manifest_audit(spark, d):
    """A manifest and a set of files, both derived from documents with known gaps, held against each other."""
    docs = table(spark, d, "documents")
    manifest = docs.where("doc_id % 10 <> 3").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"))
    return evidence.audit_manifest(manifest, docs.where("doc_id % 13 <> 5").select("doc_id", F.col("text").alias("content")))


def _markdown(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("html").alias("source"))
    return chunking.normalize_markup(pages)


@register()
def mdx_normalize(spark, d):
    """Component markup of whole pages as Markdown; tests hold it against worked cases."""
    return _markdown(spark, d)


def _chunks(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.lit(None).cast("string").alias("title"),
        F.lit("").alias("url"), F.lit("").alias("source_url"), "text",
    )
    return docs


@register()
def structural_chunks(spark, d):
    """Structure-aware chunks of whole documents; tests hold the chunker against worked cases."""
    return chunking.chunk_documents(_chunks(spark, d), chunking.ChunkingConfig(256, 32)).drop("url", "source_url")


@register()
def chunk_size_summary(spark, d):
    """Count, nearest-place percentiles and maximum of chunk sizes for each configuration of the grid."""
    return metrics.chunk_sizes(stored(chunking.grid(_chunks(spark, d)).select("config", "n_tokens"), "sizes"), "config")


@register("SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS area, count(*) AS n, string_agg(DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1), ',' ORDER BY regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS headings FROM pages GROUP BY 1")
def area_headings(spark, d):
    """Hosts by the first component of the path, as headings by area."""
    pages = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1).alias("area"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))
    counted = pages.groupBy("area", "host").agg(F.count("*").alias("n"))
    return counted.groupBy("area").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list("host")), ",").alias("headings"))
