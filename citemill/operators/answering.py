"""Grounded answers: prompts, an injected language model, and the decision table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.functions.text import alias_index, check_citations, parse_reply, strip
from citemill.sources.store import stored

#: Fixed value: what is said instead of an answer.
ABSTAIN_TEXT = "I couldn't find this in the {product} documentation, so I won't guess."


@dataclass(frozen=True)
class Response:
    """A model's reply with what it cost; a client that knows neither tokens nor seconds may return the text alone."""

    text: str
    input_tokens: int
    output_tokens: int
    latency_s: float


class LanguageModel(Protocol):
    def generate(self, prompt: str, *, system: str, temperature: float, json_schema: dict | None, max_output_tokens: int) -> Response | str: ...


class Paced:
    """A client that starts at most ``per_minute`` requests a minute."""

    def __init__(self, inner: LanguageModel, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.every, self.clock, self.sleep, self.free_at = inner, 60 / per_minute, clock, sleep, float("-inf")

    def generate(self, prompt: str, **options) -> Response | str:
        wait = self.free_at - self.clock()
        if wait > 0:
            self.sleep(wait)
        self.free_at = max(self.free_at, self.clock()) + self.every
        return self.inner.generate(prompt, **options)


_factories: dict[str, Callable[..., LanguageModel]] = {}


def register_model(name: str, factory: Callable[..., LanguageModel]) -> None:
    _factories[name] = factory


def make_model(name: str, **options) -> LanguageModel:
    if name not in _factories:
        raise ValueError(f"no model is registered as {name}")
    return _factories[name](**options)


def sources_text(found: DataFrame) -> DataFrame:
    """found(qid, rank, heading, url, text) -> (qid, n_sources, sources): the block that a prompt quotes, in rank order."""
    one = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] "), F.col("heading"), F.lit("\nURL: "), F.col("url"), F.lit("\n"), F.col("text"))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("rank", one.alias("block")))), lambda s: s["block"])
    return found.groupBy("qid").agg(F.count("*").cast("int").alias("n_sources"), F.array_join(blocks, "\n\n---\n\n").alias("sources"))


def prompt(template: str, **parts: Column) -> Column:
    """The template with {name} replaced by each column."""
    out = F.lit(template)
    for name, column in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), column)
    return out


def with_feedback(user: Column, reason: Column, n: Column) -> Column:
    return F.concat(
        user, F.lit("\n\nThe citation check refused the last answer: "), reason, F.lit(". The sources are S1 to S"), n.cast("string"),
        F.lit(". Cite one that supports it after every statement of fact, or set abstain to true if none does."),
    )


def measured(model: LanguageModel, prompt: str, **options) -> Response:
    """A reply with its cost: as the client tells, else seconds by the clock and tokens as estimated from the characters."""
    begin = time.perf_counter()
    said = model.generate(prompt, **options)
    if isinstance(said, Response):
        return said
    estimate = lambda text: len(text) // 3 + 1  # noqa: E731  as functions.text.estimated_tokens
    return Response(said, estimate(prompt + options.get("system", "")), estimate(said), time.perf_counter() - begin)


#: What a call gives, and what a response cache holds under its key.
REPLY = "reply string, input_tokens int, output_tokens int, latency_s double"


class Together:
    """A client for a job whose tasks together start at most ``per_minute`` requests a minute.

    Prompts are dealt to lanes, one task each, and a lane keeps its share of the pace. The lanes divide the
    pace evenly, so in no minute do more start, however few or many lanes run at a time.
    """

    def __init__(self, client: Callable[[], LanguageModel], per_minute: int, lanes: int = 8):
        if per_minute < 1:
            raise ValueError("a pace is one request a minute at least")
        self.lanes = max(n for n in range(1, min(lanes, per_minute) + 1) if per_minute % n == 0)
        self.client, self.each = client, per_minute // self.lanes

    def of_lane(self) -> LanguageModel:
        return Paced(self.client(), self.each)


class Cached:
    """A client behind a store of replies in a folder that driver and executors share.

    Equal requests are asked once, now and in later runs: prompt, system text, temperature and size,
    and ``model``, which names provider, model and settings, decide a reply. A hit has the tokens and seconds of
    the call that made it. Prompts are asked ``at_once`` at a time and a batch's replies are published
    whole, by a rename, so a run that fails loses one batch and readers never see a part of one. The
    store is dealt into buckets by key; ``compact`` gathers the batches into one.
    """

    def __init__(self, client: Callable[[], LanguageModel] | Together, path: str, model: str, at_once: int = 10_000):
        self.client, self.path, self.model, self.at_once = client, path.rstrip("/"), model, at_once

    def _files(self, spark: SparkSession):
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _published(self, spark: SparkSession) -> list[str]:
        files, at = self._files(spark)
        return sorted(x.getPath().toString() for x in files.listStatus(at("published"))) if files.exists(at("published")) else []

    def read(self, spark: SparkSession) -> DataFrame:
        """(bucket, key, reply, ...), a row for each key."""
        schema = f"{CACHE}, bucket string"
        batches = self._published(spark)
        if not batches:
            return spark.createDataFrame([], schema).select("bucket", *_CACHED)
        rows = reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(b) for b in batches])
        first = rows.groupBy("bucket", "key").agg(F.min(F.struct(*_CACHED[1:])).alias("r"))  # runs at the same time may have asked twice
        return first.select("bucket", "key", "r.*")

    def publish(self, replies: DataFrame) -> None:
        spark, name = replies.sparkSession, uuid.uuid4().hex
        replies.withColumn("bucket", F.substring("key", 1, 1)).write.partitionBy("bucket").parquet(f"{self.path}/staging/{name}")
        files, at = self._files(spark)
        files.mkdirs(at("published"))
        if not files.rename(at(f"staging/{name}"), at(f"published/{name}")):
            raise OSError(f"{self.path}: a batch of replies can't be published")

    def compact(self, spark: SparkSession) -> None:
        old = self._published(spark)
        if len(old) > 1:
            self.publish(self.read(spark).drop("bucket"))
            files, _ = self._files(spark)
            for batch in old:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(batch), True)

    def generate(self, prompts: DataFrame, **options) -> DataFrame:
        spark = prompts.sparkSession
        key = response_key(self.model, F.col("prompt"), **options)
        keyed = stored(prompts.select("qid", "prompt", key.alias("key")).withColumn("bucket", F.substring("key", 1, 1)), "prompts")
        missing = keyed.join(self.read(spark).select("bucket", "key"), ["bucket", "key"], "left_anti").dropDuplicates(["key"])
        missing = stored(missing.select(F.col("key").alias("qid"), "prompt"), "missing")
        parts = -(-missing.count() // self.at_once)
        for part in range(parts):
            some = missing.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part)
            self.publish(generate(some, self.client, **options).withColumnRenamed("qid", "key"))
        known = self.read(spark)
        return stored(keyed.select("qid", "bucket", "key").join(known, ["bucket", "key"]).select("qid", *_CACHED[1:]), "replies")


#: What may ask a model: a factory of clients, or one of the two above around it.
Client = Callable[[], LanguageModel] | Together | Cached


def generate(prompts: DataFrame, client: Client, system: str = "", max_output_tokens: int = 1024, temperature: float = 0.0) -> DataFrame:
    """prompts(qid, prompt) -> (qid, reply, input_tokens, output_tokens, latency_s): each worker makes one client and asks it row by row.

    The rows are written and read back, so a model is asked once, whatever reads them later.
    """
    if isinstance(client, Cached):
        return client.generate(prompts, system=system, max_output_tokens=max_output_tokens, temperature=temperature)
    asked, make = prompts.select("qid", "prompt"), client
    if isinstance(client, Together):
        asked, make = asked.repartition(client.lanes, F.xxhash64("qid")), client.of_lane

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            said = [measured(model, p, system=system, temperature=temperature, json_schema=None, max_output_tokens=max_output_tokens) for p in pdf["prompt"]]
            yield pd.DataFrame({
                "qid": pdf["qid"], "reply": [r.text for r in said], "input_tokens": [r.input_tokens for r in said],
                "output_tokens": [r.output_tokens for r in said], "latency_s": [r.latency_s for r in said],
            })

    return stored(asked.mapInPandas(run, f"qid {dict(prompts.dtypes)['qid']}, {REPLY}"), "replies")


def response_key(model: str, prompt: Column, system: str = "", temperature: float = 0.0, max_output_tokens: int = 1024) -> Column:
    """The key of a request: sha256 of a JSON array of all that decides the reply."""
    told = F.to_json(F.array(F.lit(model), F.lit(system), prompt, F.lit(str(temperature)), F.lit(str(max_output_tokens))))
    return F.sha2(told.cast("binary"), 256)


CACHE = f"key string, {REPLY}"
_CACHED = [c.split()[0] for c in CACHE.split(", ")]


def generate_cached(prompts: DataFrame, client: Client, cache: DataFrame, model: str, **options) -> tuple[DataFrame, DataFrame]:
    """``generate`` behind a table cache(key, reply, ...) that the caller keeps -> (replies, rows to append to it).

    Equal requests are asked once. A hit has the tokens and seconds of the call that made it.
    ``Cached`` is the same over a folder that it keeps itself.
    """
    keyed = prompts.select("qid", "prompt", response_key(model, F.col("prompt"), **options).alias("key"))
    missing = keyed.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])
    fresh = generate(missing.select(F.col("key").alias("qid"), "prompt"), client, **options).withColumnRenamed("qid", "key")
    known = cache.select(fresh.columns).dropDuplicates(["key"]).unionByName(fresh)
    return keyed.select("qid", "key").join(known, "key").drop("key"), fresh


def decide(
    attempts: DataFrame, product: str = "product", citation_check: bool = True, require_coverage: bool = False,
    abstain_on_violation: bool = True, min_score: float | None = None,
) -> DataFrame:
    """attempts(qid, n_sources, top_score, replies: array<string>) -> (qid, text, abstained, reason, closest, cited, check, first_valid).

    In this order: nothing retrieved or a top score under the gate (a null score never is); the last
    reply unparsable; the model abstains, pointing to its closest source; citations invalid under a
    policy that abstains, pointing to the first source; else the answer. ``replies`` are those that
    were asked for, up to the first whose check passes: so the first attempt was valid (first_valid) if
    there is one reply and its check passed; null without a check. closest is a 0-based place.
    """
    last = F.element_at("replies", -1)
    seen = attempts.withColumn("reply", F.when(F.size("replies") > 0, parse_reply(last)))
    abstain = F.coalesce(F.col("reply.abstain"), F.lit(False))
    seen = seen.withColumn("check", F.when(F.col("reply").isNotNull(), check_citations(F.coalesce("reply.answer", F.lit("")), F.col("n_sources"), abstain, require_coverage)))
    gated = (F.col("n_sources") == 0) | (F.coalesce(F.col("top_score") < F.lit(min_score), F.lit(False)) if min_score is not None else F.lit(False))
    bad = F.lit(citation_check and abstain_on_violation) & ~F.col("check.valid")
    reason = (
        F.when(gated, "low_retrieval_score").when(F.col("reply").isNull(), "malformed_output")
        .when(abstain, "model").when(bad, "citation_violation")
    )
    first = F.when(F.col("n_sources") > 0, F.lit(0))
    closest = F.when(gated, first).when(F.col("reply").isNull(), F.lit(None)).when(abstain, alias_index(F.col("reply.closest_source"), F.col("n_sources"))).when(bad, first)
    said = strip(F.coalesce("reply.answer", F.lit("")))
    text = F.when(reason.isNull() | ((reason == "model") & (said != "")), said).otherwise(ABSTAIN_TEXT.format(product=product))
    known = F.filter("check.cited", lambda a: ~F.array_contains("check.unknown", a))
    return seen.select(
        "qid", text.alias("text"), reason.isNotNull().alias("abstained"), reason.alias("reason"), closest.alias("closest"),
        F.when(reason.isNull(), known).otherwise(F.array().cast("array<string>")).alias("cited"), "check",
        F.when(F.col("check").isNotNull() & (F.size("replies") > 0), (F.size("replies") == 1) & F.col("check.valid")).alias("first_valid"),
    )


def needs_retry(replies: DataFrame, require_coverage: bool = False) -> DataFrame:
    """replies(qid, n_sources, prompt, reply) -> (qid, prompt) to ask again: after a failed check with what failed, after garbage as before."""
    parsed = replies.withColumn("r", parse_reply(F.col("reply")))
    check = check_citations(F.coalesce("r.answer", F.lit("")), F.col("n_sources"), F.coalesce("r.abstain", F.lit(False)), require_coverage)
    judged = parsed.withColumn("c", check)
    again = F.when(F.col("r").isNull(), F.col("prompt")).when(~F.col("c.valid"), with_feedback(F.col("prompt"), F.col("c.reason"), F.col("n_sources")))
    return judged.select("qid", again.alias("prompt")).where("prompt is not null")


def answer(
    questions: DataFrame, client: Client, template: str, product: str = "product", retries: int = 1, system: str = "", temperature: float = 0.0,
    max_output_tokens: int = 1024, **policy,
) -> DataFrame:
    """questions(qid, question, n_sources, sources, top_score) -> ``decide``'s rows, n_llm_calls, input_tokens, output_tokens, generation_s.

    Generation, retries with feedback (none without the citation check), decision. Questions that the gate stops, or that found
    nothing, are never sent; their calls, tokens and seconds are 0.
    """
    gate = policy.get("min_score")
    retries = retries if policy.get("citation_check", True) else 0
    asked = questions.withColumn("prompt", prompt(template, sources=F.col("sources"), question=F.trim("question"), product=F.lit(product)))
    open_ = asked.where("n_sources > 0")
    if gate is not None:
        open_ = open_.where(F.coalesce(F.col("top_score") >= gate, F.lit(True)))
    todo, said = open_.select("qid", "prompt"), None
    for attempt in range(1 + retries):
        replies = generate(todo, client, system.replace("{product}", product), max_output_tokens, temperature).withColumn("attempt", F.lit(attempt))
        said = replies if said is None else said.unionByName(replies)
        if attempt < retries:
            todo = needs_retry(replies.join(todo, "qid").join(open_.select("qid", "n_sources"), "qid"), policy.get("require_coverage", False))
    costs = {"n_llm_calls": F.count("*").cast("int"), "input_tokens": F.sum("input_tokens").cast("int"), "output_tokens": F.sum("output_tokens").cast("int"), "generation_s": F.sum("latency_s")}
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("attempt", "reply"))), lambda x: x["reply"])
    whole = said.groupBy("qid").agg(in_order.alias("replies"), *[c.alias(n) for n, c in costs.items()])
    joined = questions.join(whole.select("qid", "replies"), "qid", "left").withColumn("replies", F.coalesce("replies", F.array().cast("array<string>")))
    decided = decide(joined, product, **policy).join(whole.drop("replies"), "qid", "left")
    return decided.fillna(0, list(costs))
