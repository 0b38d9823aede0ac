"""Question sets filled to their quotas by a scripted model, in rounds that are kept."""

import json
import os

from pyspark.sql import functions as F

from citemill.operators import bm25, dense
from citemill.plans.question_set import Builder
from citemill.sources import schemas

TARGETS = {("factual", None): 5, ("numeric", None): 3, ("multi_section", None): 3, ("unanswerable", None): 3, ("adversarial", "false_premise"): 2, ("adversarial", "other_protocol"): 2}
TEMPLATES = {k: f"{k[0]} {{heading}}|{{passage}}" for k in TARGETS} | {
    ("multi_section", None): "pair {heading_a}{heading_b}|{passage_a}|{passage_b}", ("unanswerable", None): "questions {n}\n{headings}",
}


class Script:
    """Quotes passages; two thirds of the sections get quotes that aren't there, half of the near misses are answered."""

    def __init__(self, path):
        self.path = path

    def generate(self, prompt, **_):
        with open(self.path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        if prompt.startswith("questions"):
            seen = sum(map(ord, prompt))
            return json.dumps({"questions": [f"How is the colour {seen + i} made?" for i in range(4)]})
        if prompt.startswith("verify"):
            return json.dumps({"answered": "no" if int(prompt.split("colour ")[1].split(" ")[0]) % 2 else "yes", "reason": "x"})
        passages = prompt.split("|")[1:]
        quotes = [" ".join(p.split()[:6]) for p in passages]
        if "bad" in passages[0]:
            quotes[0] = "words that stand nowhere at all"
        return json.dumps({"question": f"What is {quotes[0][:20]} then?", "reference_answer": "r", "evidence": quotes})


def test_targets_are_reached_in_rounds_and_nothing_is_asked_twice(spark, tmp_path):
    rows = [(f"d{i}", ["H", f"part {i}"], f"section {i} {'good' if i % 3 == 0 else 'bad'} has these words in it and {i} of 100 numbers or 200", f"area{i % 2}") for i in range(90)]
    sections = spark.createDataFrame(rows, "doc_id string, heading_path array<string>, text string, area string")
    chunks = sections.select(F.concat("doc_id", F.lit("#0")).alias("chunk_id"), "doc_id", F.lit("u").alias("url"), F.lit("s").alias("source_url"), "heading_path", "text", F.lit(9).alias("n_tokens"), F.lit(0).alias("ordinal"))
    own = chunks.select(F.col("chunk_id").alias("id"), "text")
    index = {"chunks": chunks, "vectors": dense.embed(own), "postings": bm25.build(own).postings}
    calls = str(tmp_path / "calls")
    builder = Builder(str(tmp_path / "set"), index, lambda: Script(calls), lambda: Script(calls), TEMPLATES, "verify {question} {context}", TARGETS, ("Does it work on another chain?", "And there?", "Not needed?"))
    existing = spark.createDataFrame([("q0", None, "factual", None, "Old?", "answer", "r", [], "llm_draft", None, True, "d1 :: H > part 1")], schemas.QUESTION)
    found = builder.build(sections, existing, rounds=1)
    first, before = {r.notes for r in found.collect()}, [json.loads(x) for x in open(calls)]
    assert first
    rows = builder.build(sections, existing).collect()
    got = {}
    for r in rows:
        got.setdefault((r.category, r.subtype), []).append(r)
    assert {k: len(v) for k, v in got.items()} == TARGETS | {("factual", None): 4}
    after = [json.loads(x) for x in open(calls)]
    assert len(after) == len(set(after)) >= len(before) and first <= {r.notes for r in rows}
    assert len({r.notes for r in rows}) == len(rows) and "d1 :: H > part 1" not in {r.notes for r in rows}
    assert all(len(r.evidence) == 2 and r.evidence[0].doc_id != r.evidence[1].doc_id and " || " in r.notes for r in got["multi_section", None])
    assert all(r.expected == "abstain" and int(r.question.split("colour ")[1].split(" ")[0]) % 2 for r in got["unanswerable", None])
    assert {r.expected for r in got["adversarial", "false_premise"]} == {"correct_premise"} and [r.source for r in got["adversarial", "other_protocol"]] == ["manual"] * 2
    assert not any("bad" in e.quote for r in rows for e in r.evidence if r.category != "multi_section")
    n = len(after)
    assert len(builder.build(sections, existing).collect()) == len(rows) and sum(1 for _ in open(calls)) == n
    assert len(os.listdir(tmp_path / "set/tried")) >= 2
