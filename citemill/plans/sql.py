"""Pieces of SQL (DuckDB's dialect) that several of the registered queries' SQL share."""

from __future__ import annotations

from citemill.functions.text import STOP_WORDS
from citemill.operators.bootstrap import DRAWN, MIX, STEP

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms(name: str, table: str, key: str) -> str:
    """CTEs ending in ``name``(key, term, tf)."""
    return rf"""
{name}_w AS (SELECT {key}, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+(?:\.[A-Za-z0-9_]+)*')) AS word FROM {table}),
{name}_c AS (SELECT {key}, word, count(*) AS n FROM {name}_w GROUP BY ALL),
{name}_p AS (SELECT {key}, word, n, regexp_extract_all(regexp_replace(word, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\d+') AS parts FROM {name}_c),
{name}_t AS (SELECT {key}, n, unnest(CASE WHEN len(parts) > 1 OR contains(word, '.') THEN list_concat([lower(word)], list_transform(parts, lambda x: lower(x))) ELSE [lower(word)] END) AS term FROM {name}_p),
{name} AS (SELECT {key}, term, sum(n)::BIGINT AS tf FROM {name}_t WHERE term NOT IN ({_STOP}) GROUP BY ALL)"""


def bm25(k: int) -> str:
    """CTEs ending in ``lexical``(qid, rank, id, score): the items of benchmark over documents."""
    return terms("d", "documents", "doc_id") + "," + terms("q", "benchmark", "item_id") + f""",
len_ AS (SELECT doc_id, sum(tf) AS dl FROM d GROUP BY 1),
n_ AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(dl) FROM len_) / (SELECT count(*) FROM documents)::DOUBLE AS avgdl),
df_ AS (SELECT term, count(*) AS df FROM d GROUP BY 1),
s_ AS (
  SELECT q.item_id AS qid, d.doc_id AS id,
         round(sum(q.tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * d.tf / (1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl) + d.tf)), 6) AS score
  FROM q JOIN d USING (term) JOIN df_ USING (term) JOIN len_ ON len_.doc_id = d.doc_id, n_ GROUP BY 1, 2),
lexical AS (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id, score FROM s_ WHERE score > 0
  QUALIFY rank <= {k})"""


def hashed(name: str, counts: str, key: str) -> str:
    """CTE ``name``(key, bucket, v, norm) of hashed term vectors."""
    return f"""
{name} AS (
  SELECT {key}, h % 64 AS bucket, sum(CASE WHEN h // 64 % 2 = 1 THEN tf ELSE -tf END)::DOUBLE AS v, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS norm
  FROM (SELECT {key}, tf, ('0x' || substr(md5(term), 1, 8))::UBIGINT AS h FROM {counts}) GROUP BY 1, 2)"""


def hybrid(n: int) -> str:
    """CTEs ending in ``fused``(qid, rank, id, score, dense_rank, bm25_rank)."""
    return bm25(30) + "," + hashed("dv", "d", "doc_id") + "," + hashed("qv", "q", "item_id") + f""",
dense AS (
  SELECT qv.item_id AS qid, dv.doc_id AS id, round(sum(qv.v * dv.v) / any_value(qv.norm) / any_value(dv.norm), 6) AS score
  FROM qv JOIN dv USING (bucket) WHERE qv.norm > 0 AND dv.norm > 0 GROUP BY 1, 2),
near AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank, id FROM dense QUALIFY rank <= 30),
both_ AS (SELECT coalesce(near.qid, lexical.qid) AS qid, coalesce(near.id, lexical.id) AS id, near.rank AS dense_rank, lexical.rank AS bm25_rank
  FROM near FULL JOIN lexical ON near.qid = lexical.qid AND near.id = lexical.id),
r_ AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) AS score FROM both_),
fused AS (
  SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, least(coalesce(dense_rank, 999), coalesce(bm25_rank, 999)), id)::INT AS rank,
         id, score, dense_rank, bm25_rank FROM r_ QUALIFY rank <= {n})"""


#: A fact table of evaluation records, made from events.
RECORDS = """
e AS (SELECT *, event_id // 5 AS q FROM events),
r AS (
  SELECT event_id, q, ['naive', 'dense', 'hybrid', 'rerank', 'unchecked'][event_id % 5 + 1] AS config, 'q' || q AS qid,
         ['factual', 'multi_section', 'numeric', 'unanswerable', 'adversarial'][q % 5 + 1] AS category, q % 5 <> 3 AS answerable,
         list_transform(range(1, 6), lambda i: 'c' || (event_id * 7 + i * i * 13) % 40) AS ids,
         CASE WHEN q % 9 = 0 THEN [] ELSE [['c' || q * 3 % 40, 'c' || q * 5 % 40], ['c' || q * 11 % 40]] END AS gold_groups,
         event_type = 'error' AS abstained, user_id % 7 <> 0 AS judged, event_id % 3 AS grade, event_id % 4 AS n_claims,
         len(list_filter(range(0, event_id % 4), lambda j: (event_id + j) % 6 = 0)) AS n_unsupported,
         CASE WHEN event_type <> 'error' THEN value > 10 END AS valid, CASE WHEN event_id % 13 <> 0 THEN value > 20 END AS first_valid,
         event_id % 2 AS n_uncited, event_id % 5 <> 0 AS requested, value / 100 + value / 10 AS latency_s,
         (event_id % 1700 + event_id % 300)::DOUBLE AS tokens, (event_id % 90)::DOUBLE AS judge_tokens
  FROM e),
g AS (SELECT *, flatten(gold_groups) AS gold, answerable AND len(gold_groups) > 0 AS has_gold, answerable AND (judged OR abstained) AS graded FROM r),
f AS (SELECT *, list_min(list_filter(range(1, 6), lambda i: list_contains(gold, ids[i]))) AS first_rank FROM g),
m AS (
  SELECT config, qid, category,
         CASE WHEN has_gold THEN (coalesce(first_rank, 99) <= 1)::INT::DOUBLE END AS hit_1, CASE WHEN has_gold THEN (coalesce(first_rank, 99) <= 5)::INT::DOUBLE END AS hit_5,
         CASE WHEN has_gold THEN coalesce(1.0::DOUBLE / first_rank, 0) END AS mrr_10,
         CASE WHEN has_gold THEN len(list_filter(gold_groups, lambda x: list_has_any(x, ids)))::DOUBLE / len(gold_groups) END AS evidence_recall_5,
         CASE WHEN graded THEN CASE WHEN judged THEN grade / 2.0::DOUBLE ELSE 0 END END AS correctness,
         CASE WHEN graded THEN (judged AND grade = 2)::INT::DOUBLE END AS fully_correct,
         CASE WHEN judged AND NOT abstained THEN n_unsupported::DOUBLE END AS unsupported_claims, CASE WHEN judged AND NOT abstained THEN n_claims::DOUBLE END AS total_claims,
         CASE WHEN judged AND NOT abstained AND n_claims > 0 THEN (n_unsupported > 0)::INT::DOUBLE END AS any_unsupported,
         CASE WHEN NOT answerable THEN abstained::INT::DOUBLE END AS correct_abstention, CASE WHEN answerable THEN abstained::INT::DOUBLE END AS false_abstention,
         CASE WHEN NOT abstained AND requested AND valid IS NOT NULL THEN valid::INT::DOUBLE END AS citation_valid,
         first_valid::INT::DOUBLE AS citation_first_try_valid, CASE WHEN NOT abstained AND requested THEN (n_uncited = 0)::INT::DOUBLE END AS fully_cited,
         latency_s, tokens, judge_tokens
  FROM f)"""

MEANS = "hit_1, hit_5, mrr_10, evidence_recall_5, correctness, fully_correct, any_unsupported, correct_abstention, false_abstention, citation_valid, citation_first_try_valid, fully_cited"


def bootstrap(values: str, n_boot: int, columns: str = "grp, mean, low, high, n", before: str = "") -> str:
    """The whole statement for ``values``: a SELECT of grp, key, value. Groups are numbered, so that null is one."""
    low, high = int(0.025 * n_boot), min(n_boot - 1, int(0.975 * n_boot))
    steps = [f"x0_ AS (SELECT g, b::UBIGINT AS b, value, (h + b::UBIGINT * {STEP}) & 4294967295 AS x FROM v_, range({n_boot}) t(b))"]
    for k, (shift, factor) in enumerate(MIX):
        steps.append(f"x{k + 1}_ AS (SELECT g, b, value, xor(x, x >> {shift}) * {factor} & 4294967295 AS x FROM x{k}_)")
    drawn = " + ".join(f"(x >= {least})::INT" for least in DRAWN)
    return f"""
WITH {before}
v_ AS (SELECT grp, ('0x' || substr(md5('0:' || key), 1, 8))::UBIGINT AS h, value::DOUBLE AS value, dense_rank() OVER (ORDER BY grp) AS g FROM ({values}) WHERE value IS NOT NULL),
z_ AS (SELECT g, any_value(grp) AS grp, count(*) AS n, avg(value) AS mean FROM v_ GROUP BY 1),
{", ".join(steps)},
w_ AS (SELECT g, b, value, {drawn} AS w FROM x3_),
x_ AS (SELECT g, b, CASE WHEN sum(w) > 0 THEN sum(w * value) / sum(w) ELSE any_value(mean) END AS m FROM w_ JOIN z_ USING (g) GROUP BY 1, 2),
o_ AS (SELECT g, m, row_number() OVER (PARTITION BY g ORDER BY m, b) - 1 AS nth FROM x_),
ci_ AS (SELECT any_value(grp) AS grp, round(any_value(mean), 6) AS mean, round(max(CASE WHEN nth = {low} THEN m END), 6) AS low, round(max(CASE WHEN nth = {high} THEN m END), 6) AS high, any_value(n) AS n
  FROM o_ JOIN z_ USING (g) GROUP BY g)
SELECT {columns} FROM ci_"""
