"""Metrics, intervals, agreement, thresholds and sampling over events, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.operators import agreement, bootstrap, metrics, quantiles, sampling, threshold

from . import sql
from .tables import catalogue, table

QUERIES, SQL, register = catalogue()
CONFIGS = ("naive", "dense", "hybrid", "rerank", "unchecked")
BASELINES = ("naive", "dense")
#: Replicates for the many groups of a report's tables.
REPLICATES = 500
CATEGORIES = ("factual", "multi_section", "numeric", "unanswerable", "adversarial")


def records(spark, d):
    """The fact table: one evaluation record per event, every field a function of the event's columns."""
    e = table(spark, d, "events").withColumn("q", F.floor(F.col("event_id") / 5))
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    c = lambda n: F.concat(F.lit("c"), (n % 40).cast("string"))
    q, i = F.col("q"), F.col("event_id")
    claims = F.when(i % 4 > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), i % 4 - 1), lambda j: F.struct(F.concat(F.lit("claim "), j.cast("string")).alias("claim"), ((i + j) % 6 != 0).alias("supported"))))
    none = F.array().cast("array<struct<claim:string,supported:boolean>>")
    abstained = F.col("event_type") == "error"
    return e.select(
        pick(CONFIGS, i).alias("config"), F.concat(F.lit("q"), q.cast("string")).alias("qid"), pick(CATEGORIES, q).alias("category"),
        F.when(q % 5 == 3, "abstain").otherwise("answer").alias("expected"), abstained.alias("abstained"),
        F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: c(i * 7 + k * k * 13)).alias("retrieved_ids"),
        F.when(q % 9 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(c(q * 3), c(q * 5)), F.array(c(q * 11)))).alias("gold_groups"),
        F.when(F.col("user_id") % 7 != 0, F.struct(F.coalesce(claims, none).alias("claims"), (i % 3).cast("int").alias("correctness"))).alias("verdict"),
        F.when(~abstained, F.col("value") > 10).alias("citation_valid"), F.when(i % 13 != 0, F.col("value") > 20).alias("citation_first_attempt_valid"),
        (i % 2).alias("n_uncited_sentences"), (i % 5 != 0).alias("citations_requested"),
        (F.col("value") / 100).alias("retrieval_s"), (F.col("value") / 10).alias("generation_s"),
        (i % 1700).alias("input_tokens"), (i % 300).alias("output_tokens"), (i % 90).alias("judge_tokens"),
    )


@register(f"WITH {sql.RECORDS} SELECT * REPLACE (round(mrr_10, 6) AS mrr_10, round(evidence_recall_5, 6) AS evidence_recall_5, round(latency_s, 6) AS latency_s) FROM m")
def per_question_metrics(spark, d):
    out = metrics.per_question(records(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("mrr_10", "evidence_recall_5", "latency_s")})


_LONG = f"u AS (UNPIVOT (SELECT config, qid, category, {sql.MEANS} FROM m) ON {sql.MEANS} INTO NAME metric VALUE value)"


@register(sql.bootstrap("SELECT config || chr(9) || metric AS grp, qid AS key, value FROM u", REPLICATES, "split_part(grp, chr(9), 1) AS config, split_part(grp, chr(9), 2) AS metric, mean, low, high, n", f"{sql.RECORDS}, {_LONG},"))
def metric_summary(spark, d):
    """Mean, 95% interval and count of every metric in each configuration."""
    return metrics.summarize(metrics.per_question(records(spark, d)), n_boot=REPLICATES)


@register(f"WITH {sql.RECORDS} SELECT config, category, count(*) AS n, round(avg(correctness), 6) AS correctness, round(avg(correct_abstention), 6) AS correct_abstention FROM m GROUP BY 1, 2")
def summary_by_category(spark, d):
    return metrics.by_category(metrics.per_question(records(spark, d)))


@register(f"WITH {sql.RECORDS} SELECT config, sum(unsupported_claims) AS unsupported, sum(total_claims) AS claims, count(total_claims) AS n, round(sum(unsupported_claims) / nullif(sum(total_claims), 0), 6) AS rate FROM m GROUP BY 1")
def hallucination_rate(spark, d):
    return metrics.hallucination(metrics.per_question(records(spark, d)))


@register(f"""WITH {sql.RECORDS} SELECT config, round(quantile_cont(latency_s, 0.5), 6) AS latency_p50, round(quantile_cont(latency_s, 0.95), 6) AS latency_p95,
       round(avg(tokens), 6) AS mean_tokens, round(avg(judge_tokens), 6) AS mean_judge_tokens FROM m GROUP BY 1""")
def run_costs(spark, d):
    return metrics.costs(metrics.per_question(records(spark, d)))


@register("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("grp"), "value")
    means = events.groupBy(F.struct("grp").alias("g")).agg(F.round(F.avg("value"), 6).alias("mean"))
    found = quantiles.percentiles(events, {"p50": 0.5, "p95": 0.95}).select(F.struct("grp").alias("g"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))
    return means.join(found, "g", "left").select(F.col("g.grp").alias("event_type"), "p50", "p95", "mean")


@register(sql.bootstrap("SELECT source AS grp, doc_id AS key, quality::DOUBLE AS value FROM labels JOIN documents USING (doc_id)", 2000))
def bootstrap_ci(spark, d):
    """The share of good documents in each source, with its interval."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return bootstrap.bootstrap_ci(rows.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("value")))


@register(sql.bootstrap("SELECT lang AS grp, doc_id AS key, (quality - toxic)::DOUBLE AS value FROM labels JOIN documents USING (doc_id)", 2000))
def paired_bootstrap_diff(spark, d):
    """Quality less toxicity, document by document, in each language; documents without one are a group."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return bootstrap.paired_difference(rows.select(F.col("lang").alias("grp"), F.col("doc_id").alias("key"), F.col("toxic").cast("double").alias("a"), F.col("quality").cast("double").alias("b")))


_VERSUS = """SELECT a.config || chr(9) || b.config || chr(9) || metric AS grp, qid AS key, b.value - a.value AS value
FROM u a JOIN u b USING (qid, metric) WHERE a.config IN ('naive', 'dense') AND b.config <> a.config"""


@register(sql.bootstrap(_VERSUS, REPLICATES, "split_part(grp, chr(9), 1) AS baseline, split_part(grp, chr(9), 2) AS config, split_part(grp, chr(9), 3) AS metric, mean AS difference, low, high, n", f"{sql.RECORDS}, {_LONG},"))
def all_vs_baseline(spark, d):
    """Every other configuration less each baseline, over the questions both have, for each metric, with its 95% interval."""
    return bootstrap.against(metrics.long_form(metrics.per_question(records(spark, d))), BASELINES, n_boot=REPLICATES)


@register("""
WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS c FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), n AS (SELECT sum(c) AS n FROM c),
x AS (SELECT (SELECT sum(c) FROM c WHERE a = b) / n AS p_o, (SELECT sum(x.s * y.s) FROM (SELECT a, sum(c) AS s FROM c GROUP BY 1) x JOIN (SELECT b, sum(c) AS s FROM c GROUP BY 1) y ON x.a = y.b) / n / n AS p_e, n FROM n)
SELECT n::BIGINT AS n, round(p_o, 6) AS agreement, round(CASE WHEN p_e = 1 THEN 1 ELSE (p_o - p_e) / (1 - p_e) END, 6) AS kappa FROM x""")
def cohens_kappa(spark, d):
    return agreement.cohens_kappa(table(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))


@register("SELECT 'c' || doc_id % 3 AS config, doc_id AS qid, quality AS human, toxic AS judge FROM labels WHERE quality <> toxic")
def rater_disagreements(spark, d):
    """Items that a human (quality; null is ungraded) and a judge (toxic) grade differently."""
    rows = table(spark, d, "labels").select(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("config"), F.col("doc_id").alias("qid"), F.col("quality").alias("human"), F.col("toxic").alias("judge"))
    return agreement.disagreements(rows.select("config", "qid", "human"), rows.select("config", "qid", "judge"))


_GATE = """
WITH r AS (SELECT quality = 0 AS u, toxic = 1 AS abstained, CASE WHEN n_chars % 17 <> 0 THEN (n_chars % 200) / 10.0::DOUBLE - 10 END AS s FROM labels JOIN documents USING (doc_id))"""


def _gate(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(
        F.when(F.col("quality") == 0, "abstain").otherwise("answer").alias("expected"), (F.col("toxic") == 1).alias("abstained"), F.lit("dev").alias("split"),
        F.when(F.col("n_chars") % 17 != 0, F.col("n_chars") % 200 / 10 - 10).alias("score"),
    )


@register(_GATE + """,
c AS (SELECT NULL::DOUBLE AS t, 0 AS ordinal UNION ALL SELECT s, row_number() OVER (ORDER BY s) FROM (SELECT DISTINCT s FROM r WHERE s IS NOT NULL)
  UNION ALL SELECT s + 1e-6::DOUBLE, 1000000 + row_number() OVER (ORDER BY s) FROM (SELECT DISTINCT s FROM r WHERE s IS NOT NULL)),
p AS (SELECT t, ordinal, count(*) FILTER (u) AS n_unanswerable, count(*) FILTER (NOT u) AS n_answerable,
  coalesce(avg((abstained OR coalesce(s < t, false))::INT::DOUBLE) FILTER (u), 0) AS c, coalesce(avg((abstained OR coalesce(s < t, false))::INT::DOUBLE) FILTER (NOT u), 0) AS f
  FROM c, r GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY f <= 0.1 DESC, round(c - f, 12) DESC, ordinal)::INT AS place, round(t, 7) AS threshold, round(c, 6) AS correct_abstention, round(f, 6) AS false_abstention, n_unanswerable, n_answerable FROM p""")
def threshold_sweep(spark, d):
    return threshold.sweep(_gate(spark, d))


@register(_GATE + """
SELECT t AS threshold, round(coalesce(avg((abstained OR coalesce(s < t, false))::INT::DOUBLE) FILTER (u), 0), 6) AS correct_abstention,
       round(coalesce(avg((abstained OR coalesce(s < t, false))::INT::DOUBLE) FILTER (NOT u), 0), 6) AS false_abstention
FROM r, (VALUES (NULL::DOUBLE), (-5.0), (0.0), (2.5)) AS v(t) GROUP BY 1""")
def gate_simulation(spark, d):
    return threshold.simulate(_gate(spark, d), [None, -5.0, 0.0, 2.5])


_SPLIT = """
WITH s AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5('11:' || doc_id), doc_id) AS nth, count(*) OVER (PARTITION BY source, lang) AS n FROM documents),
z AS (SELECT source, lang, sum(count(*)) OVER (ORDER BY source, coalesce(lang, '') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents GROUP BY 1, 2)
SELECT 'q' || CASE WHEN coalesce(before, 0) + nth < 1000 THEN lpad((coalesce(before, 0) + nth)::VARCHAR, 3, '0') ELSE (coalesce(before, 0) + nth)::VARCHAR END AS id,
       s.source AS category, s.lang AS subtype, s.doc_id::VARCHAR AS draft_id, CASE WHEN nth <= round_even(n * 0.27::DOUBLE, 0) THEN 'dev' ELSE 'test' END AS split
FROM s JOIN z ON s.source IS NOT DISTINCT FROM z.source AND s.lang IS NOT DISTINCT FROM z.lang"""


@register(_SPLIT)
def stratified_split(spark, d):
    """Documents as questions: source is the category, language the subtype."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("category"), F.col("lang").alias("subtype"))
    return sampling.assign_splits(docs)


@register("SELECT split, count(*) AS n FROM (" + _SPLIT + ") GROUP BY 1")
def split_counts(spark, d):
    return stratified_split(spark, d).groupBy("split").agg(F.count("*").alias("n"))


@register("""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('5:' || doc_id), doc_id) AS nth FROM labels),
p AS (SELECT doc_id, quality FROM r ORDER BY nth, quality LIMIT 20)
SELECT doc_id, quality, row_number() OVER (ORDER BY md5('6:' || doc_id), doc_id)::INT AS place FROM p""")
def stratified_sample(spark, d):
    """Twenty items to review, grades in turn (the limit is the sample's size)."""
    return sampling.round_robin(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 20)


@register("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) <= 5")
def category_sample(spark, d):
    """Five documents of each source (the limit is the sample's size)."""
    return sampling.sample_each(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 5)


@register("""
SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'edited ' || doc_id ELSE left(text, 40) END AS question, lang AS reference_answer,
       CASE WHEN doc_id % 6 IN (0, 3) THEN 'llm_draft+human_edit' ELSE source END AS source, CASE WHEN doc_id % 11 = 0 THEN 'numeric' ELSE lang END AS category
FROM documents WHERE doc_id % 10 <> 7""")
def curation_apply(spark, d):
    """Curation decisions derived from ids, applied to documents as drafted questions."""
    docs = table(spark, d, "documents")
    questions = docs.select(F.col("doc_id").alias("id"), F.substring("text", 1, 40).alias("question"), F.col("lang").alias("reference_answer"), "source", F.col("lang").alias("category"))
    drop = docs.where("doc_id % 10 = 7").select(F.col("doc_id").alias("id"))
    rewrite = docs.where("doc_id % 6 in (0, 3)").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("edited "), F.col("doc_id").cast("string"))).alias("new_question"), F.lit(None).cast("string").alias("new_reference"))
    other = docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("id"), F.lit("numeric").alias("new_category"))
    return sampling.apply_curation(questions, drop, rewrite, other).withColumnRenamed("id", "doc_id")


@register("SELECT lang AS category, source AS subtype, count(*) AS n FROM documents GROUP BY 1, 2")
def counts_by_category(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("category"), F.col("source").alias("subtype")).agg(F.count("*").alias("n"))


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, d):
    """Documents that have no label yet."""
    from citemill.sources.files import pending

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return pending(docs, table(spark, d, "labels").select(F.col("doc_id").alias("qid"))).select(F.col("id").alias("doc_id"))
