import pytest
from pyspark.sql import functions as F

from citemill.operators import agreement, bootstrap, metrics, sampling, threshold
from citemill.sources import schemas


def record(**changes):
    base = dict.fromkeys(part.strip().split(" ")[0] for part in schemas.RECORD.replace(schemas.VERDICT, "VERDICT").split(", "))
    base |= dict(qid="q1", config="c", category="factual", expected="answer", retrieved_ids=["a", "b", "c", "d", "e"], gold_groups=[["c"]], abstained=False,
                 citations_requested=True, citation_valid=True, n_uncited_sentences=0, input_tokens=10, output_tokens=5, retrieval_s=1.0, generation_s=2.0, judge_tokens=3,
                 verdict=([("x", True), ("y", False)], 2, ""))
    return tuple((base | changes)[k] for k in base)


def measured(spark, *rows):
    return metrics.per_question(spark.createDataFrame(list(rows), schemas.RECORD))


def test_per_question(spark):
    r = measured(spark, record()).first()
    assert (r.hit_1, r.hit_5, round(r.mrr_10, 6), r.correctness, r.any_unsupported, r.latency_s, r.tokens) == (0.0, 1.0, 0.333333, 1.0, 1.0, 3.0, 15.0)
    r = measured(spark, record(abstained=True, verdict=None, citation_valid=None)).first()
    assert (r.correctness, r.false_abstention, r.unsupported_claims, r.citation_valid) == (0.0, 1.0, None, None)
    r = measured(spark, record(verdict=None)).first()
    assert r.correctness is None
    r = measured(spark, record(expected="abstain", gold_groups=[])).first()
    assert (r.hit_1, r.correct_abstention, r.false_abstention) == (None, 0.0, None)


def test_evidence_recall(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], [["a", "x"], ["d"], ["z"]]), (["a"], [])], "ids array<string>, g array<array<string>>")
    got = [tuple(r) for r in df.select(F.round(metrics.evidence_recall_at(F.col("ids"), F.col("g"), 5), 6), F.round(metrics.evidence_recall_at(F.col("ids"), F.col("g"), 1), 6)).collect()]
    assert got == [(0.666667, 0.333333), (0.0, 0.0)]


def test_micro_hallucination(spark):
    rows = measured(spark, record(verdict=([("x", True)] * 3, 2, "")), record(qid="q2", verdict=([("y", False)], 1, "")), record(qid="q3", abstained=True), record(qid="q4", verdict=([], 1, "")))
    r = metrics.hallucination(rows).first()
    assert (r.rate, r.n) == (0.25, 3)


def test_chunk_sizes_take_the_nearest_place(spark):
    r = metrics.chunk_sizes(spark.createDataFrame([(n,) for n in (1, 2, 3, 10)], "n_tokens int")).first()
    assert (r.n_chunks, r.p50, r.p95, r.largest) == (4, 3, 10, 10)


@pytest.mark.parametrize("pairs, kappa", [([("a", "a"), ("b", "b")], 1.0), ([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")], 0.0), ([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, 0.4), ([("a", "a")], 1.0)])
def test_kappa(spark, pairs, kappa):
    assert agreement.cohens_kappa(spark.createDataFrame(pairs, "a string, b string")).first().kappa == kappa


def test_paired_difference(spark):
    rows = spark.createDataFrame([("g", i, 0.0 if i < 20 else 1.0, 1.0) for i in range(40)], "grp string, key int, a double, b double")
    r = bootstrap.paired_difference(rows, n_boot=400).first()
    assert r["mean"] == 0.5 and 0.2 < r.low < 0.5 < r.high < 0.8


def test_sheet(spark):
    text = "# Sheet\n\n### hybrid / q1\n\nx\n\nYour grade (0, 1 or 2): 2\n\n### hybrid / q2\n\nYour grade (0, 1 or 2): \n"
    assert {(r.qid, r.human) for r in agreement.parse_sheet(spark.createDataFrame([(text,)], "text string")).collect()} == {("q1", 2), ("q2", None)}


def gate_rows(spark):
    rows = [("abstain", True, None), ("abstain", False, -5.0), ("abstain", False, -4.5), ("answer", False, -3.5), ("answer", False, 1.0), ("answer", False, 2.0)]
    return spark.createDataFrame([(*r, "dev") for r in rows], "expected string, abstained boolean, score double, split string")


def test_gate(spark):
    got = {r.threshold: (r.correct_abstention, r.false_abstention) for r in threshold.simulate(gate_rows(spark), [None, -3.0]).collect()}
    assert got == {None: (0.333333, 0.0), -3.0: (1.0, 0.333333)}
    best = threshold.best(gate_rows(spark)).first()
    assert best.threshold == pytest.approx(-4.499999) or -4.5 < best.threshold <= -3.5
    with pytest.raises(Exception, match="dev"):
        threshold.best(gate_rows(spark).withColumn("split", F.lit("test"))).collect()
    assert threshold.shown(threshold.sweep(gate_rows(spark))).where("threshold is null").count() == 1


def test_split(spark):
    rows = spark.createDataFrame([(f"d{i}", "factual" if i < 10 else "numeric", None) for i in range(20)], "id string, category string, subtype string")
    got = sampling.assign_splits(rows).collect()
    assert sorted(r.id for r in got) == [f"q{i:03d}" for i in range(1, 21)]
    assert sum(r.split == "dev" for r in got if r.category == "factual") == 3 == sum(r.split == "dev" for r in got if r.category == "numeric")
    assert all(r.id <= "q010" for r in got if r.category == "factual")


def test_round_robin(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(12)], "id int, grade int")
    got = sampling.round_robin(rows, "grade", "id", 6).collect()
    assert sorted(r.grade for r in got) == [0, 0, 1, 1, 2, 2] and sorted(r.place for r in got) == list(range(1, 7))


def test_curation(spark):
    q = spark.createDataFrame([(i, f"q{i}", "r", "llm", "factual") for i in "abc"], "id string, question string, reference_answer string, source string, category string")
    drop, rewrite, other = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("b", "new", None)], "id string, new_question string, new_reference string"), spark.createDataFrame([("c", "numeric")], "id string, new_category string")
    got = {r.id: r for r in sampling.apply_curation(q, drop, rewrite, other).collect()}
    assert set(got) == {"b", "c"} and got["b"].question == "new" and got["b"].source == "llm_draft+human_edit" and got["b"].reference_answer == "r" and got["c"].category == "numeric"
    assert sampling.unknown_ids(q, drop, spark.createDataFrame([("zz",)], "id string")).first().id == "zz"
