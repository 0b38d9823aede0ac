import json

import pytest

from citemill.operators import answering

GOOD, BAD = json.dumps({"answer": "It is [S1].", "abstain": False}), json.dumps({"answer": "It is [S9].", "abstain": False})
SORRY = json.dumps({"answer": "", "abstain": True, "closest_source": "s2"})


def decided(spark, replies, n=2, top=1.0, **options):
    row = spark.createDataFrame([("q", n, top, replies)], "qid string, n_sources int, top_score double, replies array<string>")
    return answering.decide(row, "X", **options).first()


@pytest.mark.parametrize("replies, options, want", [
    ([GOOD], {}, (False, None, None, ["S1"])),
    ([BAD, GOOD], {}, (False, None, None, ["S1"])),
    ([BAD, BAD], {}, (True, "citation_violation", 0, [])),
    ([BAD], {"abstain_on_violation": False}, (False, None, None, [])),
    ([BAD], {"citation_check": False}, (False, None, None, [])),
    ([SORRY], {}, (True, "model", 1, [])),
    ([GOOD, "garbage"], {}, (True, "malformed_output", None, [])),
    ([GOOD], {"min_score": 2.0}, (True, "low_retrieval_score", 0, [])),
    ([GOOD], {"min_score": 0.5}, (False, None, None, ["S1"])),
])
def test_decisions(spark, replies, options, want):
    r = decided(spark, replies, **options)
    assert (r.abstained, r.reason, r.closest, r.cited) == want


def test_nothing_found_and_null_scores(spark):
    assert decided(spark, [], n=0).reason == "low_retrieval_score"
    assert decided(spark, [GOOD], top=None, min_score=5.0).reason is None


class Scripted:
    def generate(self, prompt, **_):
        return GOOD if "citation check" in prompt else BAD


def test_answer_retries_with_feedback(spark):
    q = spark.createDataFrame([("a", "why?", 1, "[S1] x", None), ("b", "how?", 0, "", None)], "qid string, question string, n_sources int, sources string, top_score double")
    got = {r.qid: r for r in answering.answer(q, Scripted, "{sources}\n{question}").collect()}
    assert got["a"].text == "It is [S1]." and got["b"].reason == "low_retrieval_score"
    answering.register_model("scripted", Scripted)
    assert isinstance(answering.make_model("scripted"), Scripted)
    with pytest.raises(ValueError):
        answering.make_model("none")
