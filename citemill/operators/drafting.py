"""Drafted questions, probes and verdicts: a model's replies parsed and held against their passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citemill.functions.text import QUESTION_LIMIT, has_numeric, is_context_dependent, match_text, strip, word_count
from citemill.sources.store import stored

from .answering import Client, generate, prompt

MIN_QUOTE_WORDS, MIN_PROBE_WORDS = 4, 6


def acceptable_question(question: Column) -> Column:
    """Within the length that a chat takes."""
    return F.length(question) <= QUESTION_LIMIT


def validated(drafts: DataFrame, passages: DataFrame) -> DataFrame:
    """drafts(did, question, quotes), passages(did, pos, doc_id, text) -> (did, evidence) of the drafts that hold.

    A question must stand alone and not be blank, and every quote have MIN_QUOTE_WORDS words and be in
    a passage of its draft (normalised); the first such passage gives its doc_id. One miss rejects the
    draft. evidence is array<struct<doc_id, quote, pos>> in the quotes' order.
    """
    sound = drafts.where(
        (F.size("quotes") > 0) & (strip(F.col("question")) != "") & ~is_context_dependent(F.col("question"))
        & F.forall("quotes", lambda q: word_count(q) >= MIN_QUOTE_WORDS)
    )
    quotes = sound.select("did", F.size("quotes").alias("n"), F.posexplode("quotes").alias("i", "quote")).withColumn("q", match_text(F.col("quote")))
    held = passages.select("did", "pos", "doc_id", match_text(F.col("text")).alias("body"))
    hits = quotes.join(held, "did").where(F.contains("body", "q"))
    first = hits.groupBy("did", "n", "i", "quote").agg(F.min(F.struct("pos", "doc_id")).alias("hit"))
    whole = first.groupBy("did", "n").agg(F.sort_array(F.collect_list(F.struct("i", F.col("hit.doc_id").alias("doc_id"), "quote", F.col("hit.pos").alias("pos")))).alias("e"))
    return whole.where(F.size("e") == F.col("n")).select("did", F.transform("e", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["quote"].alias("quote"), x["pos"].alias("pos"))).alias("evidence"))


def validated_pairs(drafts: DataFrame, passages: DataFrame) -> DataFrame:
    """Drafts over two passages (pos 0 and 1): two different quotes at least, the first in the first passage, the second in the second."""
    good = validated(drafts, passages)
    pieces = F.size(F.array_distinct(F.transform("evidence", lambda e: F.struct(e["doc_id"], e["quote"])))) >= 2
    two = good.where(pieces)
    held = passages.where("pos in (0, 1)").groupBy("did").agg(
        F.max(F.when(F.col("pos") == 0, match_text(F.col("text")))).alias("a"), F.max(F.when(F.col("pos") == 1, match_text(F.col("text")))).alias("b")
    )
    quote = lambda i: match_text(F.col("evidence")[i]["quote"])
    return two.join(held, "did").where(F.contains(F.col("a"), quote(0)) & F.contains(F.col("b"), quote(1))).select("did", "evidence")


def probe_holds(evidence: Column, passage: Column) -> Column:
    """Whether a probe's evidence is in its passage and long enough."""
    return F.contains(match_text(passage), match_text(evidence)) & (word_count(evidence) >= MIN_PROBE_WORDS)


def parse_verdict(reply: Column) -> Column:
    """struct(claims, correctness, correctness_reason) of a judge's JSON; null unless correctness is 0, 1 or 2."""
    v = F.from_json(reply, "claims array<struct<claim:string,supported:boolean>>, correctness int, correctness_reason string")
    full = F.struct(
        F.coalesce(v["claims"], F.array().cast("array<struct<claim:string,supported:boolean>>")).alias("claims"),
        v["correctness"].alias("correctness"), F.coalesce(v["correctness_reason"], F.lit("")).alias("correctness_reason"),
    )
    return F.when(v["correctness"].between(0, 2), full)


def n_unsupported(verdict: Column) -> Column:
    return F.size(F.filter(verdict["claims"], lambda c: ~c["supported"]))


def judge(answers: DataFrame, client: Client, template: str, attempts: int = 2, system: str = "") -> DataFrame:
    """answers(qid, abstained, question, expected, reference, context, answer) -> (qid, verdict, error, judge_tokens).

    Abstentions aren't judged. An unusable verdict is asked for again, ``attempts`` times in all; what
    stays unusable has a null verdict and an error. Tokens of all attempts count.
    """
    said = F.coalesce("reference", F.lit("(none: the documentation does not answer this question)"))
    asked = answers.where("not abstained").select("qid", prompt(template, question=F.col("question"), expected=F.col("expected"), reference=said, context=F.col("context"), answer=F.col("answer")).alias("prompt"))
    open_, calls = asked, None
    for _ in range(attempts):
        got = generate(open_, client, system).withColumn("verdict", parse_verdict(F.col("reply")))
        calls = got if calls is None else calls.unionByName(got)
        open_ = open_.join(got.where("verdict is null").select("qid"), "qid", "left_semi")
    spent = F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0)).cast("int").alias("judge_tokens")
    out = calls.groupBy("qid").agg(F.first("verdict", ignorenulls=True).alias("verdict"), spent)
    return out.withColumn("error", F.when(F.col("verdict").isNull(), F.lit("the judge gave no usable verdict"))).select("qid", "verdict", "error", "judge_tokens")


_DRAFT = "question string, reference_answer string, evidence array<string>"


def _drafts(prompts: DataFrame, client: Client) -> DataFrame:
    """prompts(qid, prompt) -> (did, question, reference_answer, quotes) as the model says."""
    said = generate(prompts, client, temperature=0.7, max_output_tokens=3000)
    return said.select(F.col("qid").alias("did"), F.from_json("reply", _DRAFT).alias("d")).select("did", "d.question", "d.reference_answer", F.col("d.evidence").alias("quotes"))


def draft(sections: DataFrame, client: Client, template: str) -> DataFrame:
    """sections(did, doc_id, heading, text) -> (did, question, reference_answer, evidence): one question each, if its evidence holds."""
    asked = sections.select(F.col("did").alias("qid"), prompt(template, heading=F.col("heading"), passage=F.col("text")).alias("prompt"))
    drafts = _drafts(asked, client)
    good = validated(drafts, sections.select("did", F.lit(0).alias("pos"), "doc_id", "text"))
    return drafts.join(good, "did").select("did", "question", "reference_answer", "evidence")


def draft_pairs(pairs: DataFrame, client: Client, template: str) -> DataFrame:
    """pairs(did, a, b: struct<doc_id, heading, text>) -> as ``draft``: questions that need both passages, a quote from either."""
    parts = {f"{what}_{side}": F.col(f"{side}.{field}") for side in "ab" for what, field in (("heading", "heading"), ("passage", "text"))}
    drafts = _drafts(pairs.select(F.col("did").alias("qid"), prompt(template, **parts).alias("prompt")), client)
    passages = pairs.select("did", F.posexplode(F.array("a", "b")).alias("pos", "p")).select("did", "pos", "p.doc_id", "p.text")
    return drafts.join(validated_pairs(drafts, passages), "did").select("did", "question", "reference_answer", "evidence")


def draft_unanswerable(areas: DataFrame, client: Client, template: str, n: int = 4, most_headings: int = 25, seed: int = 7) -> DataFrame:
    """areas(area, heading) -> (area, question): near misses that a model thinks of from headings of the area, a shuffled most_headings of them in a prompt."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "area", "heading").cast("binary"))
    nth = F.row_number().over(Window.partitionBy("area").orderBy(key, "heading"))
    some = areas.select("area", "heading").distinct().withColumn("nth", nth).where(F.col("nth") <= most_headings)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "heading"))), lambda h: F.concat(F.lit("- "), h["heading"])), "\n")
    asked = some.groupBy(F.col("area").alias("qid")).agg(prompt(template, headings=listed, n=F.lit(str(n))).alias("prompt"))
    said = generate(asked, client, temperature=0.8, max_output_tokens=3000)
    told = said.select(F.col("qid").alias("area"), F.explode(F.from_json("reply", "questions array<string>")["questions"]).alias("question"))
    return told.select("area", strip(F.col("question")).alias("question")).where("question <> ''").distinct()


def verified_unanswerable(candidates: DataFrame, client: Client, template: str) -> DataFrame:
    """candidates(qid, question, context: the excerpts found for it) -> (qid, holds, reason): whether a model finds no answer there, not even in part."""
    asked = candidates.select("qid", prompt(template, question=F.col("question"), context=F.col("context")).alias("prompt"))
    told = generate(asked, client, max_output_tokens=800).select("qid", F.from_json("reply", "answered string, reason string").alias("v"))
    return told.select("qid", F.coalesce(F.col("v.answered") == "no", F.lit(False)).alias("holds"), F.coalesce("v.reason", F.lit("the verifier's reply is no JSON")).alias("reason"))


def draft_probes(sections: DataFrame, client: Client, template: str, done: DataFrame | None = None, seed: int = 13) -> DataFrame:
    """sections(doc_id, heading_path, text) -> (question, evidence, doc_id, heading_path): one probe for each document that ``done`` lacks, if its evidence holds.

    The section is chosen by seed and document, so a resumed run takes the same. 600 words of it are shown.
    """
    open_ = sections if done is None else sections.join(done.select("doc_id"), "doc_id", "left_anti")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id", F.array_join("heading_path", " > "), "text").cast("binary"))
    one = open_.groupBy("doc_id").agg(F.min_by(F.struct("heading_path", "text"), key).alias("s"))
    shown = one.select("doc_id", "s.heading_path", F.array_join(F.slice(F.split("s.text", " "), 1, 600), " ").alias("text"))
    asked = shown.select(F.col("doc_id").alias("qid"), prompt(template, heading=F.array_join("heading_path", " > "), passage=F.col("text")).alias("prompt"))
    told = generate(asked, client, temperature=0.7).select(F.col("qid").alias("doc_id"), F.from_json("reply", "question string, evidence string").alias("p"))
    return told.join(shown, "doc_id").where(probe_holds(F.col("p.evidence"), F.col("text"))).select("p.question", "p.evidence", "doc_id", "heading_path")


#: How many questions of each (category, subtype) a set needs.
TARGETS = {
    ("factual", None): 25, ("numeric", None): 20, ("multi_section", None): 20, ("unanswerable", None): 28,
    ("adversarial", "false_premise"): 8, ("adversarial", "outdated_term"): 5, ("adversarial", "other_protocol"): 7,
}
#: Sections tried for each question that is wanted.
TRIES = 3


def section_key(doc_id: Column, heading_path: Column) -> Column:
    """What a section is known by, so that none is drafted from twice."""
    return F.concat_ws(" :: ", doc_id, F.array_join(heading_path, " > "))


def draft_set(
    sections: DataFrame, existing: DataFrame, client: Client, templates: dict[tuple[str, str | None], str],
    targets: dict[tuple[str, str | None], int] = TARGETS, seed: int = 7,
) -> DataFrame:
    """New questions of single sections for each (category, subtype) of ``templates`` that ``existing`` has too few of.

    sections(doc_id, heading_path, text), existing(category, subtype, notes). A kind's sections are
    the next in shuffled order that no question was drafted from, TRIES for each question wanted
    (numeric ones need numbers in them); each kind is one batch for the model, and of what holds the
    first wanted stay.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "notes", "text").cast("binary"))
    fresh = sections.withColumn("notes", section_key(F.col("doc_id"), F.col("heading_path"))).join(existing.select("notes"), "notes", "left_anti")
    fresh = stored(fresh.withColumn("did", key).dropDuplicates(["notes"]), "sections")
    have = {(r.category, r.subtype): r["count"] for r in existing.groupBy("category", "subtype").count().collect()}  # a row for each kind of question
    out, used = None, None
    for (category, subtype), template in templates.items():
        want = targets[category, subtype] - have.get((category, subtype), 0)
        if want <= 0:
            continue
        left = fresh.where(has_numeric(F.col("text"))) if category == "numeric" else fresh
        left = left if used is None else left.join(used, "notes", "left_anti")
        chosen = stored(left.orderBy("did").limit(want * TRIES), "chosen")
        good = draft(chosen.select("did", "doc_id", F.array_join("heading_path", " > ").alias("heading"), "text"), client, template)
        expected = "correct_premise" if subtype == "false_premise" else "answer"
        rows = make_questions(good.join(chosen.select("did", "notes"), "did").orderBy("did").limit(want), category, subtype, expected)
        out = rows if out is None else out.unionByName(rows)
        used = chosen.select("notes") if used is None else used.union(chosen.select("notes"))
    return out if out is not None else make_questions(sections.sparkSession.createDataFrame([], "did string, question string, reference_answer string, evidence array<struct<doc_id:string,quote:string,pos:int>>, notes string"), "", None, "")


def make_questions(drafts: DataFrame, category: str, subtype: str | None, expected: str, source: str = "llm_draft") -> DataFrame:
    """drafts(did, question, reference_answer, evidence, notes) -> rows of the question table (``schemas.QUESTION``), without a split."""
    none = lambda kind: F.lit(None).cast(kind)
    return drafts.select(
        F.concat(F.lit("draft-"), F.col("did").cast("string")).alias("id"), none("string").alias("split"), F.lit(category).alias("category"), F.lit(subtype).cast("string").alias("subtype"),
        "question", F.lit(expected).alias("expected"), "reference_answer",
        F.transform("evidence", lambda e: F.struct(e["doc_id"].alias("doc_id"), e["quote"].alias("quote"))).alias("evidence"),
        F.lit(source).alias("source"), none("string").alias("draft_id"), F.lit(False).alias("reviewed"), "notes",
    )


def within_quota(drafts: DataFrame, quotas: dict[tuple[str, str | None], int]) -> DataFrame:
    """drafts(did, category, subtype) -> the first quota of each (category, subtype) by did; strata without a quota have none."""
    spark = drafts.sparkSession
    table = spark.createDataFrame([(c, s, n) for (c, s), n in quotas.items()], "c string, s string, quota int")
    nth = F.row_number().over(Window.partitionBy("category", "subtype").orderBy("did"))
    joined = drafts.withColumn("nth_", nth).join(table, F.col("category").eqNullSafe(F.col("c")) & F.col("subtype").eqNullSafe(F.col("s")))
    return joined.where("nth_ <= quota").select(drafts.columns)
