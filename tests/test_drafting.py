import json

from pyspark.sql import functions as F

from citemill.operators import drafting


def test_pairs_need_a_quote_from_either_passage(spark):
    passages = spark.createDataFrame([(i, 0, "A", "the pool takes a fee of 30 bps") for i in range(4)] + [(i, 1, "B", "a hook may change that **fee** later") for i in range(4)], "did int, pos int, doc_id string, text string")
    good, other = "pool takes a fee", "may change that fee"
    drafts = spark.createDataFrame([(0, "How so?", [good, other]), (1, "How so?", [other, good]), (2, "How so?", [good, good]), (3, "See the example?", [good, other])], "did int, question string, quotes array<string>")
    assert sorted(r.did for r in drafting.validated(drafts, passages).collect()) == [0, 1, 2]
    got = drafting.validated_pairs(drafts, passages).collect()
    assert [r.did for r in got] == [0] and [e.doc_id for e in got[0].evidence] == ["A", "B"]


class Judge:
    def generate(self, prompt, **_):
        return json.dumps({"claims": [{"claim": "c", "supported": False}], "correctness": 1}) if "yes" in prompt else "?"


def test_judge(spark):
    rows = spark.createDataFrame([("a", False, "q", "answer", None, "x", "yes"), ("b", False, "q", "answer", "r", "x", "no"), ("c", True, "q", "answer", "r", "x", "yes")], "qid string, abstained boolean, question string, expected string, reference string, context string, answer string")
    got = {r.qid: r for r in drafting.judge(rows, Judge, "{question} {expected} {reference} {context} {answer}").collect()}
    assert set(got) == {"a", "b"} and got["a"].verdict.correctness == 1 and got["a"].error is None and got["b"].verdict is None and got["b"].error


class Drafter:
    def generate(self, prompt, **_):
        return json.dumps({"question": "What is it?", "reference_answer": "r", "evidence": ["one two three four"]})


def test_draft_and_quota(spark):
    s = spark.createDataFrame([(1, "d", "H", "zero one two three four five"), (2, "d", "H", "none")], "did int, doc_id string, heading string, text string")
    assert [r.did for r in drafting.draft(s, Drafter, "{heading} {passage}").collect()] == [1]
    rows = spark.createDataFrame([(i, "factual" if i % 2 else "numeric", None) for i in range(10)], "did int, category string, subtype string")
    assert sorted(r.did for r in drafting.within_quota(rows, {("factual", None): 2}).collect()) == [1, 3]
    assert rows.where(drafting.acceptable_question(F.lit("x" * 501))).count() == 0
