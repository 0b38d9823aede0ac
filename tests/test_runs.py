"""Limits with odd keys, caches, configurations, sheets, drafting and experiments."""

import json
import random

import pytest
from pyspark.sql import functions as F

from citemill.functions.markup import attributes
from citemill.operators import answering, bootstrap, chunking, drafting, evidence, limits, sampling
from citemill.plans import experiments, retrieval
from citemill.sources import files, schemas, settings, sinks, store

# ---- limits ----


def test_null_and_large_keys_are_keys_like_others(spark):
    big = 9_007_199_254_740_993  # doubles can't tell it from its neighbours
    rows = [(k, i, float(i)) for i, k in enumerate([None, big, big - 1, None, big, None, big - 1, None, 7])]
    got = limits.sliding_window(spark.createDataFrame(rows, "key bigint, id int, t double"), 2, 60).collect()
    assert sorted((str(r.key), r.id) for r in got) == sorted((str(k), i) for k, i, _ in rows)
    assert sorted((str(r.key), r.id) for r in got if r.wait) == [("None", 5), ("None", 7)]
    assert limits.sliding_window(spark.createDataFrame([], "key string, id int, t double"), 2, 60).count() == 0


def test_busy_keys_are_cut_where_nothing_is_held(spark, monkeypatch):
    rng, rows, t = random.Random(4), [], 0.0
    for i in range(600):
        t += rng.choice((1.0, 5.0, 30.0, 61.0, 200.0))
        rows.append((rng.choice([None, "a"]), i, t))
    events = spark.createDataFrame(rows, "key string, id int, t double")
    whole = {r.id: r.wait for r in limits.sliding_window(events, 2, 60).collect()}
    monkeypatch.setattr(limits, "MANY_EVENTS", 10)
    assert limits._stretches(events, 60.0).select("stretch").distinct().count() > 5
    cut = {r.id: r.wait for r in limits.sliding_window(events, 2, 60).collect()}
    assert cut == whole and any(whole.values())
    limiters, want = {}, {}
    for key, i, t in rows:
        want[i] = limiters.setdefault(key, limits.SlidingWindow(2, 60)).check(t)
    assert whole == want


# ---- models ----


class Told:
    def generate(self, prompt, **_):
        return answering.Response(prompt.upper(), 7, 3, 0.5)


def test_responses_are_cached_by_all_that_decides_them(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "qid int, prompt string").where("prompt is not null")
    empty = spark.createDataFrame([], answering.CACHE)
    first, fresh = answering.generate_cached(prompts, Told, empty, "m")
    assert {(r.qid, r.reply, r.input_tokens, r.latency_s) for r in first.collect()} == {(1, "A", 7, 0.5), (2, "B", 7, 0.5), (3, "A", 7, 0.5)} and fresh.count() == 2

    class Never:
        def generate(self, prompt, **_):
            raise AssertionError("asked again")

    again, none = answering.generate_cached(prompts, Never, fresh, "m")
    assert again.count() == 3 and none.count() == 0
    keys = {answering.response_key(m, F.lit("p"), **o)._jc.toString() for m, o in (("m", {}), ("n", {}), ("m", {"system": "s"}), ("m", {"temperature": 1.0}))}
    assert len(keys) == 4


def test_pace():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    paced = answering.Paced(Told(), 30, lambda: now[0], sleep)
    for _ in range(3):
        paced.generate("x")
    assert slept == [2.0, 2.0]


def test_a_reranker_can_be_injected(spark):
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(("fee fee pool", "pool", "fee of a long text here"))], "id int, text string")
    asked = spark.createDataFrame([("q", "fee pool")], "qid string, text string")
    from citemill.operators import bm25, dense

    longest = lambda: lambda query, passages: [len(p) for p in passages]
    got = retrieval.retrieve(asked, chunks, dense.embed(chunks), bm25.build(chunks), reranker=longest).orderBy("rank").collect()
    assert [(r.id, r.rerank_score) for r in got] == [(2, 23.0), (0, 12.0), (1, 4.0)]


def test_vectors_of_counts_are_those_of_texts(spark, small):
    from citemill.operators import bm25, dense

    texts = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id as id", "text")
    whole = {r.id: r.vector for r in dense.embed(texts).collect()}
    counted = {r.id: r.vector for r in dense.embed_counts(bm25.term_counts(texts)).collect()}
    assert counted == {i: whole[i] for i in counted} and set(counted) >= {i for i, v in whole.items() if any(v)}


# ---- quotes ----


def test_quotes_of_any_length_are_found(spark, monkeypatch):
    monkeypatch.setattr(evidence, "QUOTE_CHARS", 20)  # several automata
    texts = spark.createDataFrame([(1, "The **fee** is\n30 bps."), (2, "no fees here"), (3, None), (4, "")], "id int, text string")
    quotes = spark.createDataFrame([("a", "fee"), ("b", "fee is 30"), ("c", ""), ("d", None), ("e", "FEE"), ("f", "is 30 bps. and more than that")], "qid string, quote string")
    assert {tuple(r) for r in evidence.locate(quotes, texts).collect()} == {("a", 1), ("a", 2), ("e", 1), ("e", 2), ("b", 1)}
    assert evidence.locate(quotes.limit(0), texts).count() == 0


# ---- intervals ----


def test_intervals_of_null_and_struct_groups(spark):
    rows = [(g, i, float(i % 2)) for g in ("a", None) for i in range(10)]
    df = spark.createDataFrame(rows, "grp string, key int, value double")
    got = {r.grp: r for r in bootstrap.bootstrap_ci(df, n_boot=100).collect()}
    assert set(got) == {"a", None} and all(r["mean"] == 0.5 and r.low <= 0.5 <= r.high and r.n == 10 for r in got.values())
    assert bootstrap.bootstrap_ci(df.limit(0), n_boot=100).count() == 0


# ---- curation and question sets ----


def question(spark, *ids):
    rows = [(i, None, "factual", None, f"What about {i}?", "answer", "r", [("d", "a quote of it")], "llm_draft", None, False, f"d :: {i}") for i in ids]
    return spark.createDataFrame(rows, schemas.QUESTION)


def test_unknown_curation_ids_are_an_error_and_sets_are_finalized(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("drop: {b: why}\nrewrite:\n  a: {question: new}\nrecategorize: {c: numeric}\n")
    curation, drafts = files.read_curation(spark, str(tmp_path / "c.yaml")), question(spark, *"abcd")
    done = sampling.finalize(drafts, curation)
    rows = {r.draft_id: r for r in done.collect()}
    assert set(rows) == set("acd") and {r.id for r in rows.values()} == {"q001", "q002", "q003"} and rows["a"].question == "new" and rows["c"].category == "numeric"
    sinks.write_jsonl(done, str(tmp_path / "q"))
    assert files.read_jsonl(spark, str(tmp_path / "q"), schemas.QUESTION).count() == 3
    with pytest.raises(Exception, match="unknown ids: b"):
        sampling.finalize(question(spark, *"acd"), curation).collect()


class Drafter:
    """Quotes the passage's first words; unrelated pairs get no question."""

    def generate(self, prompt, **_):
        if "questions" in prompt:
            return json.dumps({"questions": ["Why is it so?", " ", "How long is it?"]})
        if "answered" in prompt:
            return json.dumps({"answered": "no" if "long" in prompt else "partial", "reason": "x"})
        said = [" ".join(p.split()[:6]) for p in prompt.split("|")[1:]]
        return json.dumps({"question": "What is it then?", "reference_answer": "r", "evidence": said if len(said) > 1 or "probe" not in prompt else said[0]})


def sections(spark, n=12):
    rows = [(f"d{i}", ["H", str(i)], f"section {i} has these words in it and {i} of 100 numbers or 200") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, heading_path array<string>, text string")


def test_drafting_of_all_kinds(spark):
    pairs = spark.createDataFrame([(1, ("a", "H", "first passage with some words in it"), ("b", "I", "second passage that has other words in it"))], "did int, a struct<doc_id:string,heading:string,text:string>, b struct<doc_id:string,heading:string,text:string>")
    got = drafting.draft_pairs(pairs, Drafter, "{heading_a}{heading_b}|{passage_a}|{passage_b}").first()
    assert [e.doc_id for e in got.evidence] == ["a", "b"]
    areas = spark.createDataFrame([("x", f"h{i}") for i in range(40)], "area string, heading string")
    found = drafting.draft_unanswerable(areas, Drafter, "questions {n}\n{headings}").collect()
    assert {r.question for r in found} == {"Why is it so?", "How long is it?"}
    asked = spark.createDataFrame([("a", "How long?", "c"), ("b", "Why?", "c")], "qid string, question string, context string")
    assert {r.qid: r.holds for r in drafting.verified_unanswerable(asked, Drafter, "answered {question} {context}").collect()} == {"a": True, "b": False}
    probes = drafting.draft_probes(sections(spark), Drafter, "probe {heading}|{passage}", done=spark.createDataFrame([("d3",)], "doc_id string"))
    assert {r.doc_id for r in probes.collect()} == {f"d{i}" for i in range(12) if i != 3}


def test_a_set_is_filled_to_its_targets(spark):
    have = question(spark, "0", "1").withColumn("notes", F.concat(F.lit("d"), "id", F.lit(" :: H > "), "id"))
    template = "{heading}|{passage}"
    got = drafting.draft_set(sections(spark), have, Drafter, {("factual", None): template, ("adversarial", "false_premise"): template, ("numeric", None): template}, {("factual", None): 4, ("adversarial", "false_premise"): 1, ("numeric", None): 0}).collect()
    assert sorted((r.category, r.expected) for r in got) == [("adversarial", "correct_premise"), ("factual", "answer"), ("factual", "answer")]
    assert len({r.notes for r in got}) == 3 and not {r.notes for r in got} & {r.notes for r in have.collect()}


# ---- experiments ----


def test_chunk_sizes_are_scored_by_probes(spark):
    text = "\n\n".join(f"## Part {i}\n\nThe quantity of item{i} is exactly {i} units in all cases. " + "Filler words go on here. " * 20 for i in range(6))
    docs = spark.createDataFrame([("d", "d", None, "u", "s", text)], "doc_id string, slug string, title string, url string, source_url string, text string")
    probes = spark.createDataFrame([(i, f"quantity of item{i}", f"item{i} is exactly {i} units") for i in range(6)] + [(9, "nothing", "not in any chunk at all")], "pid int, question string, evidence string")
    got = experiments.grid(docs, probes, (chunking.ChunkingConfig(30, 0), chunking.ChunkingConfig(200, 0))).orderBy("max_tokens").collect()
    assert [r.max_tokens for r in got] == [30, 200] and all(r.n_probes == 7 and 0.5 < r.hit_10 <= 0.857143 and r.hit_1 <= r.hit_3 <= r.hit_5 for r in got)
    assert got[0].n_chunks > got[1].n_chunks == 6 and got[1].top5_tokens > got[0].top5_tokens and all(r.hit_2000tok == 0.857143 for r in got)
    assert experiments.markdown(spark.createDataFrame(got)).count("\n") == 4


def test_tokenizer_counts():
    from pathlib import Path

    path = next(Path("/opt/tokenizers").glob("word_bpe_49k.json"))
    count = chunking.tokenizer_counter(str(path))
    assert count("") == 0 and count("one two three") >= 3


# ---- configurations, templates, sheets, store ----


def test_settings_and_templates(tmp_path):
    (tmp_path / "p.yaml").write_text("corpus:\n  name: x\n  repo: o/docs\n  commit: c0\n  include_prefixes: [a/]\n  exclude_prefixes: []\n  extensions: ['.md']\nchunking: {max_tokens: 256}\nretrieval: {mode: dense}\nbot_limits: {global_per_day: 9}\n")
    cfg = settings.load_pipeline(str(tmp_path / "p.yaml"))
    assert (cfg.corpus.include, cfg.chunking.max_tokens, cfg.retrieval.mode, cfg.bot_limits.global_per_day, cfg.generation.temperature) == (("a/",), 256, "dense", 9, 0.0)
    json.dumps(cfg.told())
    (tmp_path / "bad.yaml").write_text("corpus: {repo: r, commit: c, include: [a], nope: 1}\n")
    with pytest.raises(ValueError, match="nope"):
        settings.load_pipeline(str(tmp_path / "bad.yaml"))
    (tmp_path / ".env").write_text("# no\nLLM_PROVIDER=told\nMODEL_KEY='abc'\n")
    got = settings.load_settings(str(tmp_path / ".env"), {"GENERATOR_MODEL": "m"})
    assert (got.llm_provider, got.generator_model, settings.required(got, "MODEL_KEY")) == ("told", "m", "abc") and "abc" not in repr(got)
    with pytest.raises(ValueError, match="OTHER_KEY"):
        settings.required(got, "OTHER_KEY")
    (tmp_path / "answer.md").write_text("# x\n\n## System\nBe brief.\n\n## User\n{sources}\n{question}\n\nEach block\n")
    t = settings.load_template(str(tmp_path), "answer", "\nEach")
    assert (t.system, t.user) == ("Be brief.", "{sources}\n{question}")


def test_sheets(spark, tmp_path):
    sheet = sinks.review_sheet(question(spark, "a"), spark.createDataFrame([("d", "https://x")], "doc_id string, published_url string"))
    assert '- evidence ([source](https://x)): "a quote of it"' in sheet.first().block
    rows = spark.createDataFrame([("c", f"q{i}", "factual", "correct_premise", "Q?", None, "A.") for i in (2, 1)], "config string, qid string, category string, expected string, question string, reference string, answer string")
    sinks.write_sheet(sinks.judge_sheet(rows), str(tmp_path / "s.md"), "Judge", "config", "qid")
    text = (tmp_path / "s.md").read_text()
    assert text.index("c / q1") < text.index("c / q2") and "(factual, false premise)" in text
    from citemill.operators import agreement

    filled = spark.createDataFrame([(text.replace("Your grade (2/1/0): ", "Your grade (2/1/0): 1", 1),)], "text string")
    assert {(r.qid, r.human) for r in agreement.parse_sheet(filled).collect()} == {("q1", 1), ("q2", None)}


def test_component_attributes():
    assert attributes("""a="1" b='2' c={"3"} d="it's" """) == {"a": "1", "b": "2", "c": "3", "d": "it's"}


def test_stored_tables_are_read_back(spark):
    rows = store.stored(spark.range(3), "x")
    assert rows.count() == 3 and all(store.scratch_dir(spark) in f for f in rows.inputFiles())
