"""Questions of users as a batch: limits first, then answers as replies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citemill.functions.text import renumber, user_hash
from citemill.operators import limits
from citemill.operators.drafting import acceptable_question
from citemill.sources import schemas
from citemill.sources.store import stored

from .assistant import Assistant


@dataclass(frozen=True)
class RateLimits:
    per_user_per_minute: int = 3
    per_user_per_day: int = 30
    global_per_day: int = 500


def numbered(requests: DataFrame, salt: str = "") -> DataFrame:
    """requests(user_id, id, t, question[, channel]) with a row number and the hashed user, written."""
    channel = F.col("channel") if "channel" in requests.columns else F.lit(None)
    own = requests.select("id", user_hash(F.col("user_id"), salt).alias("user"), channel.cast("string").alias("channel"), F.col("t").cast("double").alias("t"), "question")
    return stored(own.withColumn("row", F.monotonically_increasing_id()), "requests")


def refused() -> Column:
    """Why a question is never asked, whatever the limits: none, or more than a chat takes; else null."""
    return F.when(F.col("question").isNull(), "no_question").when(~acceptable_question(F.col("question")), "too_long")


def admitted(rows: DataFrame, rates: RateLimits = RateLimits()) -> DataFrame:
    """``numbered`` rows with wait and scope."""
    open_ = rows.where(refused().isNull()).select(F.col("user").alias("key"), F.struct("id", "row").alias("id"), "t")
    checked = limits.cascade(open_, rates.per_user_per_minute, rates.per_user_per_day, rates.global_per_day)
    told = rows.join(checked.select(F.col("id.row").alias("row"), "wait", "scope"), "row", "left")
    return told.withColumns({"wait": F.coalesce("wait", F.lit(0.0)), "scope": F.coalesce(refused(), "scope")})


def admit(requests: DataFrame, rates: RateLimits = RateLimits(), salt: str = "") -> DataFrame:
    """requests(user_id, id, t, question) -> with user (hashed), wait and scope; questions that are too long (scope too_long) or null (no_question) count for no limit.

    One row per request, whatever its id: ids may be null or repeated. Requests of the same time go by id, then by row.
    """
    return admitted(numbered(requests, salt), rates).select("id", "user", "t", "question", "wait", "scope")


def respond(rows: DataFrame, assistant: Assistant) -> tuple[DataFrame, DataFrame]:
    """``admitted`` rows -> (replies, log): what each request gets, and the lines of the usage log.

    replies(id, user, channel, t, question, wait, scope, text, sources, abstained, closest), a row for
    each request; text is null where it was refused. The log (``schemas.USAGE``) has a line for each
    answer and for each request that met a limit, none for questions that a chat doesn't take.
    """
    open_ = rows.where("scope is null").select(F.col("row").alias("qid"), "question")
    answers, seen = assistant.answer(open_)
    said = replies(answers, seen).withColumnRenamed("qid", "row")
    told = rows.join(said, "row", "left").select("id", "user", "channel", "t", "question", "wait", "scope", "text", "sources", "abstained", "closest")
    limited = rows.where(F.col("scope").isin(*limits.SCOPES)).select("user", "channel", "t", "scope", F.lit("rate_limited").alias("event"))
    answered = rows.join(answers.drop("question").withColumnRenamed("qid", "row"), "row").select(
        "user", "channel", "t", F.lit("answer").alias("event"), "question", F.col("retrieved_ids").alias("retrieved"), F.col("cited_ids").alias("cited"), F.col("text").alias("answer"),
        "abstained", F.col("reason").alias("abstain_reason"), "citation_valid", F.round("retrieval_s", 3).alias("retrieval_s"), F.round(F.col("retrieval_s") + F.col("generation_s"), 3).alias("total_s"),
        "input_tokens", "output_tokens",
    )
    both = answered.unionByName(limited, allowMissingColumns=True).withColumns({"timestamp": F.timestamp_micros((F.col("t") * 1e6).cast("bigint")), "level": F.lit("info")})
    names = [c.split()[0] for c in schemas.USAGE.split(", ")]
    return told, both.select(*names)


def ask(requests: DataFrame, assistant: Assistant, rates: RateLimits = RateLimits(), salt: str = "") -> tuple[DataFrame, DataFrame]:
    """requests(user_id, id, t seconds, question[, channel]) -> (replies, log): limits, answers and log lines of a batch."""
    return respond(stored(admitted(numbered(requests, salt), rates), "admitted"), assistant)


def replies(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """answers (``answering.decide``), shown(qid, rank, heading, url) -> (qid, text, sources, abstained, closest): markers renumbered in order of citation."""
    links = shown.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("S"), F.col("rank").cast("string")), F.struct(F.col("heading").alias("label"), "url")))).alias("links"))
    joined = answers.join(links, "qid", "left")
    sources = F.transform("cited", lambda a: F.element_at("links", a))
    closest = F.element_at("links", F.concat(F.lit("S"), (F.col("closest") + 1).cast("string")))
    return joined.select("qid", renumber(F.col("text"), F.col("cited")).alias("text"), F.coalesce(sources, F.array().cast("array<struct<label:string,url:string>>")).alias("sources"), "abstained", closest.alias("closest"))
