"""Cached and paced clients, the answer service as batch and stream, and settings that decide results."""

import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from citemill.operators import answering, bm25, dense
from citemill.plans import assistant, evaluation, pipeline, service
from citemill.sources import schemas, settings
from citemill.streaming import service as streams


class Noting:
    """Writes a line for each call to a file, whatever process it is made in."""

    def __init__(self, path):
        self.path = path

    def generate(self, prompt, **options):
        with open(self.path, "a") as f:
            f.write(json.dumps({"prompt": prompt, "at": time.time(), **options}) + "\n")
        if "broken" in prompt:
            raise RuntimeError("the provider is down")
        return answering.Response(json.dumps({"answer": "The fee is 30 bps [S1].", "abstain": "moon" in prompt, "closest_source": "S1", "correctness": 2, "claims": []}), 10, 5, 1.5)


def calls(path):
    return [json.loads(x) for x in open(path)] if os.path.exists(path) else []


def noting(tmp_path):
    path = str(tmp_path / "calls")
    return path, lambda: Noting(path)


# ---- the store of replies ----


def prompts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, prompt string")


def test_equal_requests_are_asked_once_and_keep_their_cost(spark, tmp_path):
    path, client = noting(tmp_path)
    cached = answering.Cached(client, str(tmp_path / "store"), "m")
    first = {r.qid: r for r in answering.generate(prompts(spark, "a", "b", "a"), cached).collect()}
    assert len(calls(path)) == 2 and first[0].reply == first[2].reply and first[0].latency_s == 1.5 and first[0].input_tokens == 10
    again = {r.qid: r for r in answering.generate(prompts(spark, "a", "b", "a"), answering.Cached(client, str(tmp_path / "store"), "m")).collect()}
    assert len(calls(path)) == 2 and again == first  # kept for other instances and runs


def test_all_that_decides_a_reply_is_its_key(spark, tmp_path):
    path, client = noting(tmp_path)
    store = str(tmp_path / "store")
    for cached, options in (("m", {}), ("m", {"system": "s"}), ("m", {"temperature": 0.5}), ("m", {"max_output_tokens": 9}), ("provider|reasoning=none", {}), ("m", {})):
        answering.generate(prompts(spark, "a"), answering.Cached(client, store, cached), **options)
    assert len(calls(path)) == 5


def test_batches_are_published_whole_and_compacted(spark, tmp_path):
    path, client = noting(tmp_path)
    cached = answering.Cached(client, str(tmp_path / "store"), "m", at_once=3)
    with pytest.raises(Exception, match="the provider is down"):
        answering.generate(prompts(spark, *[f"p{i}" for i in range(12)], "broken"), cached)
    kept = cached.read(spark).count()
    assert kept == sum(1 for _ in kept_keys(cached, spark)) < 13
    n = len(calls(path))
    answering.generate(prompts(spark, *[f"p{i}" for i in range(12)]), cached)
    assert len(calls(path)) - n == 12 - kept and cached.read(spark).count() == 12
    batches = len(os.listdir(tmp_path / "store/published"))
    cached.compact(spark)
    assert batches > 1 == len(os.listdir(tmp_path / "store/published")) and cached.read(spark).count() == 12
    answering.generate(prompts(spark, "p3"), cached)
    assert len(calls(path)) - n == 12 - kept


def kept_keys(cached, spark):
    return {r.key for r in cached.read(spark).collect()}


def test_tasks_keep_one_pace_together(spark, tmp_path):
    path, client = noting(tmp_path)
    begin = time.time()
    answering.generate(prompts(spark, *[f"p{i}" for i in range(36)]).repartition(12), answering.Together(client, 600, 4))
    at = sorted(c["at"] for c in calls(path))
    assert len(at) == 36 and answering.Together(client, 600, 4).lanes == 4 and answering.Together(client, 7, 4).lanes == 1
    # Ten a second: a window of a second holds at most ceil(1 / 0.4) starts of each of four lanes.
    assert max(sum(t <= u < t + 1 for u in at) for t in at) <= 12 and time.time() - begin > 2


# ---- the service ----


def index_of(spark):
    texts = {"fees#0": "Every swap pays a fee of 30 bps to the pool.", "hooks#0": "A hook runs before the swap and may refuse it."}
    rows = [(c, c[:-2], f"https://x/{c[:-2]}", "s", [c[:-2].title()], t, len(t.split()), 0) for c, t in texts.items()]
    chunks = spark.createDataFrame(rows, schemas.CHUNK)
    own = chunks.select(F.col("chunk_id").alias("id"), "text")
    return {"chunks": chunks, "vectors": dense.embed(own), "postings": bm25.build(own).postings}


REQUESTS = [
    ("u1", "a", 1.0, "What fee does a swap pay?", "chat"), ("u1", "b", 2.0, "And again?", "chat"), ("u2", "c", 3.0, "Is there a moon?", None), ("u3", "d", 4.0, "x" * 900, "chat"),
    ("u3", "e", 5.0, "What is a hook?", "web"), ("u4", "f", 6.0, "What fee?", "web"), ("u1", "g", 70.0, "A fee?", "chat"), ("u5", "h", 80.0, None, "web"), ("u6", "i", 90.0, "Who pays?", "web"),
]
SCHEMA = "user_id string, id string, t double, question string, channel string"
RATES = service.RateLimits(1, 10, 4)


def lines(log):
    return sorted((r.event, r.user, str(r.question), str(r.scope), str(r.answer), str(r.abstain_reason), str(r.retrieved), str(r.cited), str(r.timestamp)) for r in log.collect())


def test_a_batch_of_requests_is_limited_answered_and_logged(spark, tmp_path):
    path, client = noting(tmp_path)
    told, log = service.ask(spark.createDataFrame(REQUESTS, SCHEMA), assistant.Assistant(index_of(spark), client, "{sources}\n{question}", mode="dense"), RATES, "s")
    by = {r.id: r for r in told.collect()}
    assert {i: r.scope for i, r in by.items()} == {"a": None, "b": "user_minute", "c": None, "d": "too_long", "e": None, "f": None, "g": "global_day", "h": "no_question", "i": "global_day"}
    assert by["a"].text == "The fee is 30 bps [1]." and [s.url for s in by["a"].sources] == ["https://x/fees"] and by["c"].abstained and by["b"].text is None and by["b"].wait == 59.0
    rows = log.collect()
    assert sorted(r.event for r in rows) == ["answer"] * 4 + ["rate_limited"] * 3 and log.columns == [c.split()[0] for c in schemas.USAGE.split(", ")]
    assert not any("u1" in str(r) for r in rows) and len(calls(path)) == 4
    empty, none = service.ask(spark.createDataFrame([], SCHEMA), assistant.Assistant(index_of(spark), client, "{question}", mode="dense"), RATES)
    assert empty.count() == 0 and none.count() == 0


def test_a_stream_with_replayed_batches_gives_what_the_batch_gives(spark, tmp_path):
    path, client = noting(tmp_path)
    cached = answering.Cached(client, str(tmp_path / "store"), "m")
    helper = assistant.Assistant(index_of(spark), cached, "{sources}\n{question}", mode="dense")
    _, log = service.ask(spark.createDataFrame(REQUESTS, SCHEMA), helper, RATES, "s")
    want = lines(log)
    asked = len(calls(path))
    (tmp_path / "in").mkdir()
    own = streams.Service(helper, str(tmp_path / "out"), RATES, "s")

    def run(part, number):
        (tmp_path / f"in/{number}.json").write_text("".join(json.dumps(dict(zip(("user_id", "id", "t", "question", "channel"), r))) + "\n" for r in part))
        q = own.start(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination()

    run(REQUESTS[:5], 0)
    run(REQUESTS[5:7], 1)
    os.remove(tmp_path / "cp/commits/1")  # as if the driver had died before the batch was committed
    if os.path.exists(tmp_path / "cp/commits/.1.crc"):
        os.remove(tmp_path / "cp/commits/.1.crc")
    run(REQUESTS[7:], 2)
    # A batch whose log is not whole is made again, from the times held before it.
    before = lines(spark.read.schema(schemas.USAGE).json(str(tmp_path / "out/log")))
    last = max(os.listdir(tmp_path / "out/log"))
    shutil.copytree(tmp_path / "out/log", tmp_path / "saved")
    os.remove(tmp_path / f"out/log/{last}/_SUCCESS")
    rows = spark.createDataFrame(
        [(r.id, r.user, r.channel, r.t, r.question, 0.0, service_scope(r)) for r in spark.read.parquet(str(tmp_path / f"out/replies/{last}")).collect()], streams._ROW)
    own.batch(rows, int(last.partition("=")[2]))
    assert before == want and lines(spark.read.schema(schemas.USAGE).json(str(tmp_path / "out/log"))) == want
    assert len(calls(path)) == asked
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out/replies")).collect()} == {r[1] for r in REQUESTS}


def service_scope(r):
    return None if r.scope == "global_day" else r.scope


def test_a_second_evaluation_makes_no_call(spark, tmp_path):
    path, client = noting(tmp_path)
    rows = [("q1", "test", "factual", None, "What fee does a swap pay?", "answer", "30 bps", [("fees", "fee of 30 bps")]), ("q2", "test", "unanswerable", None, "Is there a moon?", "abstain", None, [])]
    questions = spark.createDataFrame(rows, "id string, split string, category string, subtype string, question string, expected string, reference_answer string, evidence array<struct<doc_id:string,quote:string>>")
    cached, judge = (answering.Cached(client, str(tmp_path / "store"), m) for m in ("writer", "judge"))
    configs = [evaluation.EvalConfig("plain", "dense", citation_check=False), evaluation.EvalConfig("dense", "dense")]
    run = lambda: evaluation.evaluate(questions, configs, index_of(spark), cached, judge, "{sources}\n{question}", "judge {question} {answer}").drop("created_at", "retrieval_s").orderBy("config", "qid").collect()
    first, n = run(), len(calls(path))
    assert n == 3 and len(first) == 4  # both configurations send the same prompts
    assert run() == first and len(calls(path)) == n


# ---- settings ----


def configured(spark, tmp_path, name, **blocks):
    told = {"corpus": {"repo": "o/docs", "commit": "c0", "include_prefixes": [""], "extensions": [".md"], "published_url_template": "https://x/{path}"}, "retrieval": {"mode": "hybrid", "top_k": 2}}
    for block, values in blocks.items():
        told[block] = told.get(block, {}) | values
    (tmp_path / f"{name}.yaml").write_text(json.dumps(told))
    return pipeline.Pipeline(spark, settings.load_pipeline(str(tmp_path / f"{name}.yaml")), str(tmp_path / name), str(tmp_path))


def test_settings_decide_what_runs(spark, tmp_path):
    path, client = noting(tmp_path)
    (tmp_path / "docs/a").mkdir(parents=True)
    (tmp_path / "docs/fees.md").write_text("# Fees\n\nEvery swap pays a fee of 30 bps to the pool. " + "Many more words stand here. " * 40)
    (tmp_path / "docs/a/hooks.md").write_text("# Hooks\n\nA hook runs before the swap.\n")
    for version in ("answer", "brief"):
        (tmp_path / f"{version}.md").write_text(f"## System\nYou are {version} for {{product}}.\n\n## User\n{{sources}}\n{{question}}\n")
    base = configured(spark, tmp_path, "base")
    n = base.build(str(tmp_path / "docs")).count()
    questions = spark.createDataFrame([("q", "What fee does a swap pay?"), ("m", "Is there a moon?")], "qid string, question string")
    answers = lambda p: {r.qid: r for r in p.answer(questions, client)[0].collect()}
    own = answers(base)
    assert own["q"].text.startswith("The fee") and len(own["q"].retrieved_ids) == 2 and calls(path)[-1]["system"] == "You are answer for product." and calls(path)[-1]["temperature"] == 0.0
    # Corpus and chunking decide the index, and an index of other settings is refused.
    assert configured(spark, tmp_path, "few", corpus={"include_prefixes": ["a/"]}).build(str(tmp_path / "docs")).count() == 1
    assert configured(spark, tmp_path, "small", chunking={"max_tokens": 40, "overlap_tokens": 0}).build(str(tmp_path / "docs")).count() > n
    with pytest.raises(ValueError, match="stale"):
        with_other_path(configured(spark, tmp_path, "stale", chunking={"max_tokens": 40}), base.path).index()
    with pytest.raises(ValueError, match="encoder"):
        configured(spark, tmp_path, "enc", embedding={"model": "none-such"}).build(str(tmp_path / "docs"))

    def other(name, **blocks):
        return with_other_path(configured(spark, tmp_path, name, **blocks), base.path)

    assert len(answers(other("top", retrieval={"top_k": 1}))["q"].retrieved_ids) == 1
    assert answers(other("gate", retrieval={"mode": "hybrid_rerank"}, generation={"min_rerank_score": 0.99}))["q"].reason == "low_retrieval_score"
    brief = answers(other("brief-run", generation={"prompt_version": "brief", "protocol_name": "Mill", "temperature": 0.7, "max_output_tokens": 77}))
    assert brief["q"].text and (calls(path)[-1]["system"], calls(path)[-1]["temperature"], calls(path)[-1]["max_output_tokens"]) == ("You are brief for Mill.", 0.7, 77)
    with pytest.raises(ValueError, match="reranker"):
        other("rer", retrieval={"reranker_model": "none-such"}).retrieval()
    limited, _ = other("limits", bot_limits={"per_user_per_minute": 1}).ask(spark.createDataFrame(REQUESTS[:2], SCHEMA), client)
    assert {r.id: r.scope for r in limited.collect()} == {"a": None, "b": "user_minute"}


class Careless:
    def generate(self, prompt, **_):
        return json.dumps({"answer": "It is [S9].", "abstain": False})


def test_citation_settings(spark):
    questions = spark.createDataFrame([("q", "What fee?")], "qid string, question string")
    said = lambda retries=1, **policy: assistant.Assistant(index_of(spark), Careless, "{sources}{question}", mode="dense", retries=retries, policy=policy).answer(questions)[0].first()
    assert (said().reason, said().n_llm_calls) == ("citation_violation", 2) and said(retries=0).n_llm_calls == 1
    flagged = said(abstain_on_violation=False)
    assert flagged.reason is None and flagged.citation_valid is False
    unchecked = said(citation_check=False)
    assert unchecked.reason is None and unchecked.n_llm_calls == 1


def with_other_path(p, path):
    return pipeline.Pipeline(p.spark, p.cfg, path, p.templates)
