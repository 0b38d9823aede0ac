"""Citations, replies, decisions, usage and limits over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from citemill.functions import text as T
from citemill.operators import answering, drafting, limits
from citemill.streaming import usage

from .tables import catalogue, table

QUERIES, SQL, register = catalogue()

#: Conversations as answers: a marker before some full stops.
_ANSWERS = r"""a AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '([a-z]{3})\. ', '\1 [S' || ((conv_id + turn) % 6 + 1) || ']. ', 'g'), ', ', ' [S' || ((conv_id * 3 + turn) % 5 + 1) || '], ') AS answer FROM conversations)"""


def _answers(spark, d):
    rows = table(spark, d, "conversations")
    first = F.concat(F.lit("$1 [S"), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("string"), F.lit("]. "))
    marked = F.regexp_replace("text", F.lit(r"([a-z]{3})\. "), first)
    second = F.concat(F.lit(" [S"), ((F.col("conv_id") * 3 + F.col("turn")) % 5 + 1).cast("string"), F.lit("], "))
    comma = F.instr(marked, ", ")
    once = F.when(comma > 0, F.concat(F.substring(marked, F.lit(1), comma - 1), second, F.substring(marked, comma + 2, F.length(marked)))).otherwise(marked)
    return rows.select("conv_id", "turn", "role", once.alias("answer"))


_CITED = r"list_transform(regexp_extract_all(answer, '\[S(\d+)\]', 1), lambda n: 'S' || n)"
_CHECK = rf"""
WITH {_ANSWERS},
m AS (SELECT *, {_CITED} AS all_, turn % 7 = 6 AS abstained FROM a),
c AS (SELECT *, list_filter(all_, lambda x, i: list_position(all_, x) = i) AS cited FROM m),
u AS (SELECT *, list_filter(cited, lambda x: x NOT IN ('S1', 'S2', 'S3', 'S4')) AS unknown,
  CASE WHEN abstained THEN [] ELSE list_filter(list_transform(flatten(list_transform(regexp_split_to_array(regexp_replace(answer, '(?s)```.*?```', ' ', 'g'), '\n\s*\n'),
    lambda p: string_split(regexp_replace(trim(p), '([.!?])\s+([A-Z0-9\x60"(])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda s: trim(s)),
    lambda s: s <> '' AND NOT ends_with(s, ':') AND len(regexp_split_to_array(s, '\s+')) >= 4 AND NOT regexp_matches(s, '\[S\d+\]')) END AS uncited FROM c),
r AS (SELECT *, CASE WHEN len(unknown) > 0 THEN 'cites sources that were not retrieved: ' || array_to_string(unknown, ', ')
  WHEN NOT abstained AND len(cited) = 0 THEN 'answer has no citations' WHEN len(uncited) > 0 THEN len(uncited) || ' sentence(s) without a citation' END AS reason FROM u)
"""


@register(_CHECK + "SELECT conv_id, turn, reason IS NULL AS valid, array_to_string(cited, ',') AS cited, array_to_string(unknown, ',') AS unknown, len(uncited)::INT AS n_uncited, reason FROM r")
def citation_check(spark, d):
    check = T.check_citations(F.col("answer"), F.lit(4), F.col("turn") % 7 == 6)
    return _answers(spark, d).withColumn("c", check).select(
        "conv_id", "turn", F.col("c.valid").alias("valid"), F.array_join("c.cited", ",").alias("cited"), F.array_join("c.unknown", ",").alias("unknown"),
        F.size("c.uncited_sentences").alias("n_uncited"), F.col("c.reason").alias("reason"),
    )


@register(rf"""
WITH {_ANSWERS}, m AS (SELECT *, {_CITED} AS all_ FROM a), c AS (SELECT *, list_filter(all_, lambda x, i: list_position(all_, x) = i) AS cited FROM m)
SELECT conv_id, turn, list_reduce(list_prepend(answer, list_transform(cited, lambda x, i: x || '=' || i)), lambda t, x: replace(t, '[' || split_part(x, '=', 1) || ']', '[' || split_part(x, '=', 2) || ']')) AS text FROM c""")
def renumber_citations(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.renumber(F.col("answer"), T.cited_aliases(F.col("answer"))).alias("text"))


@register(rf"WITH {_ANSWERS} SELECT conv_id, turn, regexp_replace(answer, '\[S(?:0+|0*[4-9]|0*[1-9][0-9]+)\]', '', 'g') AS text FROM a")
def strip_unknown_markers(spark, d):
    return _answers(spark, d).select("conv_id", "turn", T.strip_unknown_markers(F.col("answer"), F.lit(3)).alias("text"))


@register(r"""
WITH q AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN regexp_matches(text, '(?i)\b(this|the) (passage|section|example|snippet|guide|page|document|code|table|text)\b|\b(above|below|following|aforementioned)\b') THEN 'context-dependent wording' END,
  CASE WHEN n < 5 THEN 'very short' END, CASE WHEN turn % 3 > 0 AND conv_id % 4 = 0 AND conv_id % 8 <> 4 THEN 'no evidence' END,
  CASE WHEN n > 80 THEN 'long reference' END], lambda x: x IS NOT NULL), ';') AS flags FROM q""")
def lint_questions(spark, d):
    rows = table(spark, d, "conversations")
    subtype = F.when(F.col("conv_id") % 8 == 4, "other_protocol")
    flags = T.lint(F.col("text"), F.col("turn") % 3 > 0, F.col("conv_id") % 4, subtype, F.col("text"))
    return rows.select("conv_id", "turn", F.array_join(flags, ";").alias("flags"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@register(f"""
WITH t AS (SELECT conv_id, turn, text, {_ESC.format('text')} AS body, chr(10) || chr(10) || '<b>Sources</b>' || chr(10) || '[1] <a href="https://docs.example.org/' || conv_id || '?a&amp;b">Turn &lt;' || turn || '&gt;</a>' AS tail FROM conversations)
SELECT conv_id, turn, CASE
  WHEN turn % 5 = 4 THEN '🤷 ' || body || chr(10) || chr(10) || '<i>I only answer from the R&amp;D docs and won''t guess.</i>'
  WHEN length(body) + length(tail) > 4096 THEN {_ESC.format("substr(text, 1, greatest(0, length(text) - (length(body) + length(tail) - 4096) - 22))")} || '…' || tail
  ELSE body || tail END AS html FROM t""")
def chat_html(spark, d):
    rows = table(spark, d, "conversations")
    link = F.struct(F.concat(F.lit("Turn <"), F.col("turn").cast("string"), F.lit(">")).alias("label"), F.concat(F.lit("https://docs.example.org/"), F.col("conv_id").cast("string"), F.lit("?a&b")).alias("url"))
    none = F.lit(None).cast("struct<label:string,url:string>")
    return rows.select("conv_id", "turn", T.chat_html(F.col("text"), F.array(link), F.col("turn") % 5 == 4, none, "R&D").alias("html"))


@register("""
SELECT conv_id AS qid, count(*)::INT AS n_sources, string_agg('[S' || (turn + 1) || '] ' || role || chr(10) || 'URL: u' || turn || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS sources
FROM conversations WHERE turn < 5 GROUP BY 1""")
def prompt_render(spark, d):
    """The first five turns of a conversation as a prompt's sources (five is the prompt's size)."""
    rows = table(spark, d, "conversations").where("turn < 5")
    return answering.sources_text(rows.select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("heading"), F.concat(F.lit("u"), F.col("turn").cast("string")).alias("url"), "text"))


_REPLY = """CASE (conv_id + turn) % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{"answer": "Yes it is [S1].", "abstain": false}' WHEN 2 THEN '{"answer": "", "abstain": true, "closest_source": " s2 "}'
  WHEN 3 THEN '```json\\n{"answer": "See [S9].", "abstain": false}\\n```' WHEN 4 THEN '{"answer": "No marker here at all.", "abstain": false}' ELSE '{"answer": "Sorry.", "abstain": true, "closest_source": "S7"}' END"""


@register("""
WITH r AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS k, CASE WHEN turn % 11 = 10 THEN 0 ELSE 3 END AS n, CASE WHEN turn % 4 <> 3 THEN conv_id % 10 - 5.0::DOUBLE END AS s FROM conversations),
x AS (SELECT *, n = 0 OR coalesce(s < -3, false) AS gated FROM r)
SELECT conv_id, turn, CASE WHEN gated OR k IN (0, 2, 3, 4) THEN 'I couldn''t find this in the R&D documentation, so I won''t guess.' WHEN k = 1 THEN 'Yes it is [S1].' ELSE 'Sorry.' END AS text,
       gated OR k <> 1 AS abstained, CASE WHEN gated THEN 'low_retrieval_score' WHEN k = 0 THEN 'malformed_output' WHEN k IN (2, 5) THEN 'model' WHEN k IN (3, 4) THEN 'citation_violation' END AS reason,
       CASE WHEN gated THEN CASE WHEN n > 0 THEN 0 END WHEN k = 2 THEN 1 WHEN k IN (3, 4) THEN 0 END::INT AS closest, CASE WHEN NOT gated AND k = 1 THEN 'S1' ELSE '' END AS cited
FROM x""")
def answer_decision(spark, d):
    """The decision table over recorded replies, one of six kinds for each turn."""
    rows = table(spark, d, "conversations")
    attempts = rows.select(
        F.struct("conv_id", "turn").alias("qid"), F.when(F.col("turn") % 11 == 10, 0).otherwise(3).alias("n_sources"),
        F.when(F.col("turn") % 4 != 3, F.col("conv_id") % 10 - F.lit(5.0)).alias("top_score"), F.array(F.expr(_REPLY)).alias("replies"),
    )
    out = answering.decide(attempts, "R&D", min_score=-3.0)
    return out.select("qid.conv_id", "qid.turn", "text", "abstained", "reason", "closest", F.array_join("cited", ",").alias("cited"))


@register("SELECT conv_id, sum(length(text) // 3 + 1)::BIGINT AS tokens, count(*) AS calls, sum((role = 'assistant')::INT)::BIGINT AS answers FROM conversations GROUP BY 1")
def answer_token_sums(spark, d):
    tokens = T.estimated_tokens(F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(tokens).cast("long").alias("tokens"), F.count("*").alias("calls"), F.sum((F.col("role") == "assistant").cast("int")).alias("answers"))


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def usage_tumbling_window(spark, d):
    return usage.per_window(table(spark, d, "events"))


@register("""
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def usage_sessions(spark, d):
    return usage.sessions(table(spark, d, "events"))


@register("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::DOUBLE[] AS held, 0.0::DOUBLE AS wait FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN len(own) < 3 THEN list_append(own, t) ELSE own END, CASE WHEN len(own) < 3 THEN 0.0::DOUBLE ELSE 86400 - (t - own[1]) END
  FROM (SELECT e.user_id, e.n, e.event_id, e.t, list_filter(f.held, lambda x: e.t - x < 86400) AS own FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, event_id, round(wait, 3) AS wait FROM f WHERE n > 0""")
def rate_limit_sliding(spark, d):
    """At most three events a user in any day; a refused event isn't recorded."""
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.to_timestamp_ltz("ts")) / 1e6).alias("t"))
    return limits.sliding_window(events, 3, 86400).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.round("wait", 3).alias("wait"))


_EVENTS = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, floor(value * 10)::BIGINT AS tokens FROM events)"


@register(f"""
WITH RECURSIVE {_EVENTS},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
f AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::DOUBLE AS t, []::DOUBLE[] AS m, []::DOUBLE[] AS d, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM r WHERE n = 1
  UNION ALL
  SELECT user_id, n, event_id, t, CASE WHEN len(m) < 2 THEN list_append(m, t) ELSE m END, CASE WHEN len(m) < 2 AND len(d) < 3 THEN list_append(d, t) ELSE d END,
         CASE WHEN len(m) < 2 THEN 0.0::DOUBLE ELSE 60 - (t - m[1]) END, CASE WHEN len(m) < 2 AND len(d) >= 3 THEN 86400 - (t - d[1]) ELSE 0.0::DOUBLE END
  FROM (SELECT r.user_id, r.n, r.event_id, r.t, list_filter(f.m, lambda x: r.t - x < 60) AS m, CASE WHEN len(list_filter(f.m, lambda x: r.t - x < 60)) < 2 THEN list_filter(f.d, lambda x: r.t - x < 86400) ELSE f.d END AS d
        FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)),
mine AS (SELECT user_id, event_id, t, w1 + w2 AS wait, CASE WHEN w1 > 0 THEN 'user_minute' WHEN w2 > 0 THEN 'user_day' END AS scope FROM f WHERE n > 0),
p AS (SELECT list({{'id': event_id, 't': t}} ORDER BY t, event_id) AS l FROM mine WHERE scope IS NULL),
g AS (
  SELECT unnest(list_reduce(l, lambda a, x: {{
    'h': CASE WHEN len(list_filter(a.h, lambda y: x.t - y < 86400)) < 250 THEN list_append(list_filter(a.h, lambda y: x.t - y < 86400), x.t) ELSE list_filter(a.h, lambda y: x.t - y < 86400) END,
    'o': list_append(a.o, {{'id': x.id, 'wait': CASE WHEN len(list_filter(a.h, lambda y: x.t - y < 86400)) < 250 THEN 0.0::DOUBLE ELSE 86400 - (x.t - list_filter(a.h, lambda y: x.t - y < 86400)[1]) END}})
  }}, {{'h': []::DOUBLE[], 'o': []::STRUCT(id BIGINT, wait DOUBLE)[]}}).o) AS x FROM p)
SELECT user_id, event_id, round(wait, 3) AS wait, scope FROM mine WHERE scope IS NOT NULL
UNION ALL SELECT user_id, event_id, round(x.wait, 3), CASE WHEN x.wait > 0 THEN 'global_day' END FROM g JOIN mine ON event_id = x.id""")
def rate_limit_cascade(spark, d):
    """User-minute, user-day and global-day limits one after the other."""
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.to_timestamp_ltz("ts")) / 1e6).alias("t"))
    return limits.cascade(events, 2, 3, 250).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), F.round("wait", 3).alias("wait"), "scope")


@register(f"""
WITH RECURSIVE {_EVENTS},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS n FROM e),
f AS (
  SELECT user_id, event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::STRUCT(t DOUBLE, k BIGINT)[] AS h, 0.0::DOUBLE AS wait FROM r WHERE n = 1
  UNION ALL
  SELECT user_id, event_type, n, event_id, CASE WHEN fits THEN list_append(h, {{'t': t, 'k': tokens}}) ELSE h END, CASE WHEN fits THEN 0.0::DOUBLE ELSE 60 - (t - h[1].t) + 0.1::DOUBLE END
  FROM (SELECT *, len(h) = 0 OR list_sum(list_transform(h, lambda x: x.k)) + least(tokens, 300) <= 300 AS fits
        FROM (SELECT r.user_id, r.event_type, r.n, r.event_id, r.t, r.tokens, list_filter(f.h, lambda x: r.t - x.t <= 60) AS h
              FROM f JOIN r ON r.user_id = f.user_id AND r.event_type IS NOT DISTINCT FROM f.event_type AND r.n = f.n + 1)))
SELECT user_id, event_type, event_id, round(wait, 3) AS wait FROM f WHERE n > 0""")
def token_limit(spark, d):
    """Tokens per minute for each user and event type."""
    events = table(spark, d, "events").select(
        F.to_json(F.struct("user_id", "event_type")).alias("key"), F.struct("event_id", "user_id", "event_type").alias("id"),  # a null leaves its field out, so no two keys are one
        (F.unix_micros(F.to_timestamp_ltz("ts")) / 1e6).alias("t"), F.floor(F.col("value") * 10).alias("tokens"),
    )
    return limits.token_window(events, 300).select("id.user_id", "id.event_type", "id.event_id", F.round("wait", 3).alias("wait"))


_NORMED = r"lower(trim(regexp_replace(regexp_replace({0}, '\*\*|`', '', 'g'), '\s+', ' ', 'g')))"
_DRAFTS = rf"""
WITH w AS (SELECT doc_id, text, left(text, 60) AS question, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, text, question, list_concat([array_to_string(w[3:8], ' ')], CASE WHEN doc_id % 4 = 0 THEN ['words that are not there'] WHEN doc_id % 4 = 1 THEN [array_to_string(w[10:14], ' ')] ELSE [] END) AS quotes FROM w),
v AS (SELECT doc_id, quotes FROM d WHERE trim(question) <> ''
  AND NOT regexp_matches(question, '(?i)\b(this|the) (passage|section|example|snippet|guide|page|document|code|table|text)\b|\b(above|below|following|aforementioned)\b')
  AND len(list_filter(quotes, lambda q: len(list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '')) < 4 OR NOT contains({_NORMED.format('text')}, {_NORMED.format('q')}))) = 0)
"""


@register(_DRAFTS + "SELECT doc_id, len(quotes)::INT AS n_quotes FROM v")
def evidence_validation(spark, d):
    """Quotes cut from each document, some of them not in it, held against the document."""
    docs = table(spark, d, "documents")
    cut = docs.select("doc_id", "text", T.words(F.col("text")).alias("w"))
    part = lambda a, n: F.array(F.array_join(F.slice("w", a, n), " "))
    more = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("words that are not there"))).when(F.col("doc_id") % 4 == 1, part(10, 5)).otherwise(F.array().cast("array<string>"))
    drafts = cut.select(F.col("doc_id").alias("did"), F.substring("text", 1, 60).alias("question"), F.concat(part(3, 6), more).alias("quotes"))
    passages = docs.select(F.col("doc_id").alias("did"), F.lit(0).alias("pos"), "doc_id", "text")
    return drafting.validated(drafts, passages).select(F.col("did").alias("doc_id"), F.size("evidence").alias("n_quotes"))


@register(rf"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, contains({_NORMED.format('text')}, {_NORMED.format("array_to_string(w[2:1 + doc_id % 12], ' ')")}) AND len(w[2:1 + doc_id % 12]) >= 6 AS holds FROM w WHERE text IS NOT NULL""")
def probe_validation(spark, d):
    cut = table(spark, d, "documents").where("text is not null").select("doc_id", "text", T.words(F.col("text")).alias("w"))
    evidence = F.array_join(F.slice("w", F.lit(2), (F.col("doc_id") % 12).cast("int")), " ")
    return cut.select("doc_id", drafting.probe_holds(evidence, F.col("text")).alias("holds"))


@register("""
WITH k AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k FROM conversations)
SELECT conv_id, turn, k IN (0, 1, 4) AS usable, CASE k WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 4 THEN 1 END::INT AS correctness, CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 4 THEN 0 END::INT AS unsupported FROM k""")
def judge_verdicts(spark, d):
    """Recorded judge replies, one of five kinds for each turn, parsed."""
    reply = F.expr("""CASE (conv_id + turn) % 5 WHEN 0 THEN '{"claims": [{"claim": "a", "supported": true}, {"claim": "b", "supported": false}], "correctness": 2}'
      WHEN 1 THEN '{"correctness": 0, "correctness_reason": "x"}' WHEN 2 THEN '{"correctness": 7}' WHEN 3 THEN 'no json' ELSE '{"claims": [], "correctness": 1}' END""")
    v = F.col("v")
    return table(spark, d, "conversations").withColumn("v", drafting.parse_verdict(reply)).select(
        "conv_id", "turn", v.isNotNull().alias("usable"), v["correctness"].alias("correctness"), F.when(v.isNotNull(), drafting.n_unsupported(v)).alias("unsupported")
    )
