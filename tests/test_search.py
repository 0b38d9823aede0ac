import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill.operators import bm25, cells, dense, evidence, fusion
from citemill.sources.store import scratch_dir


def rankings(spark, *lists):
    return spark.createDataFrame([("q", i, r, x) for i, ids in enumerate(lists) for r, x in enumerate(ids, 1)], "qid string, list_id int, rank int, id string")


def fused(spark, lists, **options):
    return [(r.id, r.score) for r in fusion.reciprocal_rank_fusion(rankings(spark, *lists), **options).orderBy("rank").collect()]


def test_fusion_cases(spark):
    got = dict(fused(spark, [["a", "b"], ["b"]], k=10))
    assert math.isclose(got["a"], 1 / 11) and math.isclose(got["b"], 1 / 12 + 1 / 11)
    assert [x for x, _ in fused(spark, [["a1", "a2"], ["b1", "b2"]])] == ["a1", "b1", "a2", "b2"]
    assert [x for x, _ in fused(spark, [["x", "p", "y"], ["q", "r", "y"]], k=0)][:2] == ["q", "x"]
    assert fused(spark, [["x", "p", "y"], ["q", "r", "y"]])[0][0] == "y"
    assert dict(fused(spark, [["a", "a", "b"], ["b"]], k=0, weights={0: 1.0, 1: 0.5})) == {"a": 1.0, "b": 1.0}
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(rankings(spark, ["a"]), k=-1)


def test_rerank_keeps_order_on_ties(spark):
    found = spark.createDataFrame([("q", r, f"d{r}") for r in range(1, 5)], "qid string, rank int, id string")
    got = fusion.rerank(found, F.when(F.col("id") == "d4", 1.0).otherwise(0.0), 3).orderBy("rank").collect()
    assert [r.id for r in got] == ["d4", "d1", "d2"]


def test_bm25_against_a_loop(spark):
    texts = {1: "swap fee swap pool", 2: "pool", 3: "the of", 4: "fee fee fee swap limit order"}
    index = bm25.build(spark.createDataFrame(list(texts.items()), "id int, text string"))
    toks = {k: [w for w in t.split() if w not in ("the", "of")] for k, t in texts.items()}
    avg = sum(map(len, toks.values())) / 4

    def score(q, d):
        s = 0.0
        for t in q.split():
            df = sum(t in x for x in toks.values())
            tf = toks[d].count(t)
            s += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf / (1.5 * (0.25 + 0.75 * len(toks[d]) / avg) + tf) if tf else 0
        return round(s, 6)

    asked = spark.createDataFrame([("a", "swap swap fee"), ("b", "the of"), ("c", "pool")], "qid string, text string")
    got = {(r.qid, r.id): r.score for r in bm25.search(asked, index, 3).collect()}
    want = {(q, d): score(t, d) for q, t in (("a", "swap swap fee"), ("c", "pool")) for d in texts if score(t, d) > 0}
    assert got == want


def test_dense_skips_vectors_without_direction(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, []), (6, [2.0, 0.0])], "id int, vector array<double>")
    q = spark.createDataFrame([("q", [3.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "qid string, vector array<double>")
    got = dense.top_k(q, v, 2).orderBy("rank").collect()
    assert [(r.qid, r.id, r.score) for r in got] == [("q", 1, 1.0), ("q", 6, 1.0)]
    assert dense.top_k(q.where("qid = 'n'"), v, 2).count() == 0


def test_embedding_cache(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c")], "id int, text string")
    empty = spark.createDataFrame([], "key string, vector array<double>")
    first = dense.embed_missing(texts, empty, "m")
    assert first.count() == 2 and dense.embed_missing(texts, first, "m").count() == 0 and dense.embed_missing(texts, first, "n").count() == 2


def test_evidence(spark):
    chunks = spark.createDataFrame([("c1", "d", "The **Fee** is\n30 bps."), ("c2", "d", "nothing"), ("c3", "e", "the fee is 30 bps.")], "chunk_id string, doc_id string, text string")
    quotes = spark.createDataFrame([("q", 0, "d", "fee is 30"), ("q", 1, "d", "absent")], "qid string, pos int, doc_id string, quote string")
    groups = evidence.gold_groups(evidence.resolve(quotes, chunks))
    assert groups.first().gold_groups == [["c1"], []] and evidence.unresolved(groups).count() == 1


def test_locate_finds_quotes_that_begin_within_words(spark):
    texts = spark.createDataFrame([(1, "xone two three four five sixy"), (2, "one two three"), (3, None)], "id int, text string")
    quotes = spark.createDataFrame([("q", "one two three four five six")], "qid string, quote string")
    assert [(r.qid, r.id) for r in evidence.locate(quotes, texts).collect()] == [("q", 1)]


def test_token_budget_counts_what_stands_before(spark):
    ranked = spark.createDataFrame([("q", 1, 100, False), ("q", 2, 900, True), ("r", 1, 100, False), ("r", 2, 1, True)], "qid string, rank int, n_tokens int, is_hit boolean")
    assert {r.qid: r.hit for r in evidence.hit_within_tokens(ranked, 101).collect()} == {"q": 1.0, "r": 1.0}
    assert {r.qid: r.hit for r in evidence.hit_within_tokens(ranked, 100).collect()} == {"q": 0.0, "r": 0.0}


def test_hybrid_modes(spark):
    from citemill.plans import retrieval

    texts = spark.createDataFrame([(i, t) for i, t in enumerate(("swap fee", "pool fee", "limit order", "fee order swap"))], "id int, text string")
    asked = spark.createDataFrame([("q", "swap fee")], "qid string, text string")
    for mode in retrieval.MODES:
        got = retrieval.retrieve(asked, texts, dense.embed(texts), bm25.build(texts), mode, top_k=2).orderBy("rank").collect()
        assert got[0].id == 0 and len(got) == 2 and (got[0].rerank_score is None) == (mode != "hybrid_rerank")
    with pytest.raises(ValueError):
        retrieval.retrieve(asked, texts, texts, bm25.build(texts), "x")


def test_stored_postings_give_the_same_and_read_less(spark, small, tmp_path, monkeypatch):
    """Blocks that can't matter aren't read; ties, repeated terms and queries of unknown words go as in a plain search."""
    monkeypatch.setattr(bm25, "BLOCK", 4)
    texts = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id as id", "text")
    asked = spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("item_id as qid", "text").limit(12)
    asked = asked.union(spark.createDataFrame([(-1, "zzz qqq"), (-2, "the of"), (-3, "on on the thin"), (-4, None)], "qid long, text string"))
    index = bm25.build(texts)
    want = {tuple(r) for r in bm25.search(asked, index, 5).collect()}
    bm25.Stored.write(index, str(tmp_path / "postings"))
    held = bm25.Stored.open(spark, str(tmp_path / "postings"))
    assert {tuple(r) for r in held.search(asked, 5).collect()} == want and want
    plain = bm25.term_counts(asked.selectExpr("qid as id", "text")).select("id", "term").join(held.heads, "term").agg(F.sum("n")).first()[0]
    read = held.postings_read()
    assert read["lead"] + read.get("rest", 0) < plain


def test_stored_postings_are_written_in_parts_that_leave_nothing(spark, tmp_path, monkeypatch):
    """Tables of a part go with it; the blocks after a term's first hold ids only, and a term of one block isn't stored twice."""
    monkeypatch.setattr(bm25, "BLOCK", 4)
    monkeypatch.setattr(bm25, "PARTS", 2)
    texts = spark.createDataFrame([(i, f"often {'abcdefghij'[i] * 5} {'klmno'[i // 2] * 5}") for i in range(10)], "id long, text string")
    scratch = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(scratch.glob("*"))
    bm25.Stored.write(bm25.build(texts), str(tmp_path / "postings"))
    assert set(scratch.glob("*")) == before
    held = bm25.Stored.open(spark, str(tmp_path / "postings"))
    assert {r.term for r in held.places.collect()} == {"often"}
    assert [x.weight for r in held.rest.collect() for x in r.row] == [None] * 6 and held.heads.count() == 16


def test_queries_of_different_lengths_are_searched_together(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 0.0]), (4, [0.0]), (5, [])], "id int, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0, 2.0]), (3, [1.0, 1.0, 1.0])], "qid int, vector array<double>")
    assert [(r.qid, r.id, r.score) for r in dense.top_k(asked, vectors, 1).orderBy("qid").collect()] == [(1, 1, 0.995037), (2, 3, 0.0), (3, 3, 0.816497)]


def test_cells_give_the_same_neighbours_and_are_mostly_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 20)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((25, 16))
    v = np.concatenate([centres[rng.integers(0, 25, 900)] + 0.15 * rng.standard_normal((900, 16)), np.tile(centres[0], (60, 1)), rng.standard_normal((40, 16))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16)]
    vectors = spark.createDataFrame(rows, "id int, vector array<double>")
    asked = vectors.where("id % 25 = 0 or id > 1990").selectExpr("id as qid", "vector").union(spark.createDataFrame([(-1, [1.0, 2.0])], "qid int, vector array<double>"))
    cells.Cells.write(vectors, str(tmp_path / "cells"))
    held = cells.Cells.open(spark, str(tmp_path / "cells"))
    for own in (False, True):
        got = {tuple(r) for r in held.search(asked, 7, exclude_self=own).collect()}
        assert got == {tuple(r) for r in dense.top_k(asked.where("qid <> -1 and qid < 2001"), vectors.where("id < 2001"), 7, exclude_self=own).collect()} and len(got) == 40 * 7
    assert 0 < held.share_read() < 0.5
    cells.Cells.write(vectors.where("false"), str(tmp_path / "none"))
    assert cells.Cells.open(spark, str(tmp_path / "none")).search(asked, 3).count() == 0
