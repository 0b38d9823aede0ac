"""Retrieval, fusion and evidence over documents, benchmark and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions.text import match_text, terms, word_count, words
from citemill.operators import bm25, dense, evidence, fusion
from citemill.sources.store import stored

from . import sql
from .tables import catalogue, table

QUERIES, SQL, register = catalogue()


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _counts(spark, d):
    """Terms of all documents, tokenised once for what a query builds of them."""
    return bm25.term_counts(_texts(spark, d))


def _lexical(spark, d, k, counts=None):
    counts = stored(_counts(spark, d), "terms") if counts is None else counts
    return bm25.search(_items(spark, d), bm25.build(_texts(spark, d), counts), k)


def _near(spark, d, k, counts):
    asked = dense.embed(_items(spark, d).withColumnRenamed("qid", "id")).withColumnRenamed("id", "qid")
    return dense.top_k(asked, dense.embed_counts(counts), k)


def _both(spark, d, k):
    """Dense and lexical rankings over one stored tokenising."""
    counts = stored(_counts(spark, d), "terms")
    return _near(spark, d, k, counts), _lexical(spark, d, k, counts)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@register("WITH" + sql.terms("d", "documents", "doc_id") + " SELECT doc_id, term, tf FROM d")
def tokenize_terms(spark, d):
    return bm25.term_counts(_texts(spark, d)).withColumnRenamed("id", "doc_id")


@register("WITH" + sql.terms("d", "documents", "doc_id") + " SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM d GROUP BY 1")
def term_stats(spark, d):
    return bm25.term_statistics(bm25.term_counts(_texts(spark, d)))


@register("WITH" + sql.bm25(10) + " SELECT qid, rank, id, score FROM lexical")
def bm25_topk(spark, d):
    return _lexical(spark, d, 10)


_COSINE = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS qid, v.vec_id AS id, v.label = q.label AS gold, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) AS score
  FROM v AS q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id, score, gold FROM s QUALIFY rank <= 10)
"""


def _neighbours(spark, d):
    vectors = _vectors(spark, d)
    asked = vectors.where("id % 100 = 0").select(F.col("id").alias("qid"), "vector")
    return vectors, dense.top_k(asked, vectors.select("id", "vector"), 10, exclude_self=True)


@register(_COSINE + "SELECT qid, rank, id, score FROM r")
def dense_topk(spark, d):
    return _neighbours(spark, d)[1]


@register(_COSINE + """, f AS (SELECT qid, min(CASE WHEN gold THEN rank END) AS first_rank FROM r GROUP BY 1)
SELECT qid, first_rank, (coalesce(first_rank, 99) <= 1)::INT::DOUBLE AS hit_1, (coalesce(first_rank, 99) <= 5)::INT::DOUBLE AS hit_5, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS rr_10 FROM f""")
def hit_mrr_recall(spark, d):
    """Vectors of the query's label are gold: first hit, hit@1, hit@5, reciprocal rank."""
    from citemill.operators.metrics import hit_at, reciprocal_rank

    vectors, found = _neighbours(spark, d)
    labels = vectors.select("id", "label")
    asked = found.select("qid").distinct().join(labels.select(F.col("id").alias("qid"), F.col("label").alias("want")), "qid")
    marked = found.join(labels, "id").join(asked, "qid")
    gold = marked.where("label = want").select("qid", "id")
    first = F.col("first_rank")
    return evidence.first_hits(found, gold).select("qid", "first_rank", hit_at(first, 1).alias("hit_1"), hit_at(first, 5).alias("hit_5"), F.round(reciprocal_rank(first), 6).alias("rr_10"))


@register("WITH" + sql.hybrid(20) + """, l AS (SELECT qid, 0 AS list_id, dense_rank AS rank, id FROM fused)
SELECT qid, rank, id, round(score, 9) AS score FROM fused""")
def rrf_fusion(spark, d):
    lists = [found.select("qid", F.lit(i).alias("list_id"), "rank", "id") for i, found in enumerate(_both(spark, d, 30))]
    lists = lists[0].unionByName(lists[1])
    return fusion.reciprocal_rank_fusion(lists).where("rank <= 20").withColumn("score", F.round("score", 9))


@register("WITH" + sql.hybrid(20) + " SELECT qid, rank, id, round(score, 9) AS score, dense_rank, bm25_rank FROM fused")
def hybrid_candidates(spark, d):
    return fusion.candidates(*_both(spark, d, 30), 20).withColumn("score", F.round("score", 9))


@register("WITH" + sql.hybrid(20) + """,
o AS (
  SELECT fused.qid, fused.rank AS old, fused.id, dense_rank, bm25_rank,
         round(coalesce((SELECT count(*) FROM q JOIN d USING (term) WHERE q.item_id = fused.qid AND d.doc_id = fused.id)::DOUBLE / nullif((SELECT count(*) FROM q WHERE q.item_id = fused.qid), 0), 0), 6) AS rerank_score
  FROM fused)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, old)::INT AS rank, id, dense_rank, bm25_rank, rerank_score FROM o QUALIFY rank <= 5""")
def hybrid_rerank_proxy(spark, d):
    from . import retrieval

    texts, counts = _texts(spark, d), stored(_counts(spark, d), "terms")
    found = retrieval.retrieve(_items(spark, d), texts, dense.embed_counts(counts), bm25.build(texts, counts))
    return found.select("qid", "rank", "id", "dense_rank", "bm25_rank", "rerank_score")


_NORM = r"lower(trim(regexp_replace(regexp_replace(text, '\*\*|`', '', 'g'), '\s+', ' ', 'g')))"
_HELD = f"""
WITH q AS (SELECT item_id, {_NORM} AS t FROM benchmark), x AS (SELECT doc_id, {_NORM} AS t, text, source FROM documents),
h AS (SELECT item_id, doc_id FROM q JOIN x ON contains(x.t, q.t))
"""


@register(_HELD + "SELECT item_id, count(doc_id) AS n_docs, coalesce(string_agg(doc_id, ',' ORDER BY doc_id), '') AS doc_ids FROM q LEFT JOIN h USING (item_id) GROUP BY 1")
def evidence_resolution(spark, d):
    """Which documents hold each benchmark passage; items that none holds have an empty list."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("quote"))
    found = evidence.locate(quotes, _texts(spark, d))
    lists = found.groupBy("qid").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    return quotes.join(lists, "qid", "left").select(F.col("qid").alias("item_id"), F.coalesce("n", F.lit(0)).alias("n_docs"), F.coalesce(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), F.lit("")).alias("doc_ids"))


@register(_HELD + "SELECT item_id FROM q WHERE item_id NOT IN (SELECT item_id FROM h)")
def unresolved_evidence(spark, d):
    return evidence_resolution(spark, d).where("n_docs = 0").select("item_id")


@register(rf"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, array_to_string(w[2:6], ' ') AS text FROM w), n AS (SELECT doc_id, {_NORM} AS q FROM q),
l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM w), u AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM l),
b AS (SELECT doc_id, doc_id || '#' || pos AS chunk_id, {_NORM} AS body FROM u)
SELECT n.doc_id AS qid, coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id), '') AS chunk_ids FROM n LEFT JOIN b ON b.doc_id = n.doc_id AND contains(b.body, n.q) GROUP BY 1""")
def evidence_by_document(spark, d):
    """Words 2 to 6 of each document as a quote, resolved to the document's lines: all that hold it, none where it crosses a line's end."""
    docs = table(spark, d, "documents").where("text is not null")
    quote = F.array_join(F.slice(words(F.col("text")), 2, 5), " ")
    quotes = docs.select(F.col("doc_id").alias("qid"), F.lit(0).alias("pos"), "doc_id", quote.alias("quote"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    chunks = lines.select(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("chunk_id"), "doc_id", "text")
    return evidence.resolve(quotes, chunks).select("qid", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@register("WITH" + sql.bm25(2000) + f""",
x AS (SELECT doc_id, {_NORM} AS t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents),
i AS (SELECT item_id, {_NORM} AS t FROM benchmark),
l AS (SELECT l.qid, l.rank, x.n, contains(x.t, i.t) AS hit, coalesce(sum(x.n) OVER (PARTITION BY l.qid ORDER BY l.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM lexical l JOIN x ON x.doc_id = l.id JOIN i ON i.item_id = l.qid)
SELECT qid, max((used < 2000 AND hit)::INT)::DOUBLE AS hit FROM l GROUP BY 1""")
def hit_at_token_budget(spark, d):
    """Whether 2,000 tokens of the whole ranking reach the passage.

    A ranked document has a word at least, so none past rank 2,000 is within the budget: that bound loses nothing.
    """
    budget = 2000
    texts = _texts(spark, d)
    ranked = _lexical(spark, d, budget).join(texts.select("id", word_count(F.col("text")).alias("n_tokens")), "id")
    bodies = texts.select("id", match_text(F.col("text")).alias("body"))
    items = _items(spark, d).select("qid", match_text(F.col("text")).alias("q"))
    held = evidence.reached(ranked, budget).join(bodies, "id").join(items, "qid")
    return evidence.hit_within_tokens(held.select("qid", "rank", "n_tokens", F.contains("body", "q").alias("is_hit")), budget)


@register("WITH" + sql.bm25(10) + """, o AS (SELECT l.qid, l.rank, l.id FROM lexical l JOIN documents x ON x.doc_id = l.id
  JOIN (SELECT qid, source AS own FROM lexical JOIN documents ON doc_id = id WHERE rank = 1) f ON f.qid = l.qid WHERE x.source <> f.own)
SELECT qid, arg_min(id, rank) AS id, min(rank) AS rank FROM o GROUP BY 1""")
def other_document_candidate(spark, d):
    """The first hit from another source than the best hit's."""
    found = _lexical(spark, d, 10).join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    own = found.where("rank = 1").select("qid", F.col("source").alias("own"))
    return fusion.first_of_other_document(found.join(own, "qid"), F.col("own"), F.col("source"))


@register("SELECT doc_id, sha256('m' || chr(0) || text) AS key FROM documents WHERE sha256('m' || chr(0) || text) NOT IN (SELECT sha256('m' || chr(0) || d.text) FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL)")
def embedding_cache_misses(spark, d):
    """Documents whose text no labelled document has: what a content-addressed cache of those would still encode."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return dense.missing(docs, dense.keyed(labelled, "m"), "m").select("doc_id", "key")


@register("SELECT doc_id, sum(n) AS n_tokens FROM (" + "WITH" + sql.terms("d", "documents", "doc_id") + " SELECT doc_id, tf AS n FROM d) GROUP BY 1")
def document_lengths(spark, d):
    docs = _texts(spark, d).select(F.col("id").alias("doc_id"), F.size(terms(F.col("text"))).cast("long").alias("n_tokens"))
    return docs.where("n_tokens > 0")
