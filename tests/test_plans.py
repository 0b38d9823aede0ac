import json

from citemill.plans import evaluation, ingest, service
from citemill.sources import files, sinks

CFG = files.CorpusConfig("docs", "c0ffee", ("",), extensions=(".md", ".mdx"), url_template="https://x.example/{path}")


class Writer:
    def generate(self, prompt, **_):
        return json.dumps({"answer": "The fee is 30 bps [S1].", "abstain": "moon" in prompt, "closest_source": "S1"})


class Judge:
    def generate(self, prompt, **_):
        return json.dumps({"claims": [{"claim": "fee", "supported": True}], "correctness": 2})


def test_corpus_to_report(spark, tmp_path):
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus/fees.mdx").write_text("---\ntitle: Fees\n---\n# Fees\n\nEvery swap pays a fee of 30 bps to the pool.\n")
    (tmp_path / "corpus/hooks.md").write_text("# Hooks\n\nA hook runs before the swap and may refuse it.\n")
    corpus = files.read_corpus(spark, str(tmp_path / "corpus"), CFG)
    chunks = ingest.chunk_corpus(corpus, files.manifest_of(corpus, CFG))
    got = {r.chunk_id: r for r in chunks.collect()}
    assert set(got) == {"fees#000", "hooks#000"} and got["fees#000"].heading_path == ["Fees"] and got["fees#000"].url == "https://x.example/fees"
    ingest.build_index(chunks, str(tmp_path / "index"), {"model": "hashed"})
    index = sinks.read_index(spark, str(tmp_path / "index"), {"model": "hashed"})
    rows = [("q1", "test", "factual", None, "What fee does a swap pay?", "answer", "30 bps", [("fees.mdx", "fee of 30 bps")]), ("q2", "test", "unanswerable", None, "Is there a moon?", "abstain", None, [])]
    questions = spark.createDataFrame(rows, "id string, split string, category string, subtype string, question string, expected string, reference_answer string, evidence array<struct<doc_id:string,quote:string>>")
    configs = [evaluation.EvalConfig("hybrid", "hybrid"), evaluation.EvalConfig("rerank")]
    records = evaluation.evaluate(questions, configs, index, Writer, Judge, "{sources}\n{question}", "{answer}")
    sinks.append_records(records, str(tmp_path / "run"))
    stored = files.read_records(spark, str(tmp_path / "run"))
    by = {(r.config, r.qid): r for r in stored.collect()}
    assert len(by) == 4 and by["rerank", "q1"].gold_groups == [["fees#000"]] and by["rerank", "q1"].cited_ids == ["fees#000"] and by["hybrid", "q2"].abstain_reason == "model"
    summary = evaluation.report(stored, "test", n_boot=50)
    means = {(r.config, r.metric): r["mean"] for r in summary.collect()}
    assert means["rerank", "hit_1"] == 1.0 and means["hybrid", "correct_abstention"] == 1.0 and means["rerank", "correctness"] == 1.0
    assert "| hit_1 |" in sinks.report_markdown(summary)
    q1 = by["rerank", "q1"]
    assert q1.citation_first_attempt_valid is True and q1.n_llm_calls == 1 and q1.input_tokens > q1.output_tokens > 0 < q1.judge_tokens
    assert 0 < q1.retrieval_s and 0 <= q1.generation_s < 60 and q1.created_at and by["hybrid", "q2"].judge_tokens == 0
    told = evaluation.write_results(stored, str(tmp_path / "run"), baselines=("hybrid",), n_boot=50)
    assert told["vs_baseline"]["hybrid"]["rerank"]["hit_5"]["diff"] == 0.0 and told["summaries"]["rerank"]["tokens_per_question"] > 0
    assert json.loads((tmp_path / "run/results.json").read_text())["split"] == "test" and "Paired differences from `hybrid`" in (tmp_path / "run/results.md").read_text()
    one = evaluation.fingerprint({"corpus": "c0ffee"}, configs, questions, {"answer": "x"}, {"generator": "m"})
    assert evaluation.run_id(one) == evaluation.run_id(evaluation.fingerprint({"corpus": "c0ffee"}, configs, questions.orderBy("id"), {"answer": "x"}, {"generator": "m"}))
    assert evaluation.run_id(one) != evaluation.run_id(one | {"prompts": {}}) and evaluation.run_id(one).startswith("run-")
    left = evaluation.evaluate(questions, configs, index, Writer, Judge, "{sources}\n{question}", "{answer}", done=stored.where("qid = 'q1'"))
    assert {(r.config, r.qid) for r in left.select("config", "qid").collect()} == {("hybrid", "q2"), ("rerank", "q2")}


def test_admission_and_replies(spark):
    rows = spark.createDataFrame([("u", i, float(i), "short") for i in range(4)] + [("u", 9, 1.5, "x" * 501)], "user_id string, id int, t double, question string")
    got = {r.id: (r.scope, r.wait) for r in service.admit(rows, service.RateLimits(2, 10, 10)).collect()}
    assert got == {0: (None, 0.0), 1: (None, 0.0), 2: ("user_minute", 58.0), 3: ("user_minute", 57.0), 9: ("too_long", 0.0)}
    answers = spark.createDataFrame([("q", "A [S2]. B [S1].", False, None, ["S2", "S1"]), ("r", "no", True, 0, [])], "qid string, text string, abstained boolean, closest int, cited array<string>")
    shown = spark.createDataFrame([(q, r, f"H{r}", f"u{r}") for q in "qr" for r in (1, 2)], "qid string, rank int, heading string, url string")
    got = {r.qid: r for r in service.replies(answers, shown).collect()}
    assert got["q"].text == "A [1]. B [2]." and [s.url for s in got["q"].sources] == ["u2", "u1"] and got["q"].closest is None and got["r"].closest.label == "H1"
