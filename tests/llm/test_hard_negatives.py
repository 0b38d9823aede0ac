"""Hard negatives against loops over all pairs, in Python's integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from citemill.llm import hard_negatives as h

SCHEMA = "vec_id bigint, label int, embedding array<double>, `q` string, uid string, anchor int"


def by_hand(rows):
    sound = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)
    ]
    out = []
    most = 2**63 - 1
    dot = lambda a, b: max(-most, min(most, sum(x * y for x, y in zip(a, b))))
    for n, (a, label, v) in enumerate(sound):
        if a % 50:
            continue
        scored = [(-dot(v, w), i, other == label) for m, (i, other, w) in enumerate(sound) if m != n and len(w) == len(v)]
        for p, pos, _ in sorted(x for x in scored if x[2])[:5]:
            fits = sorted(x for x in scored if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p)[:3]
            out += [(a, pos, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(x) for x in v], "x", "u", 3) for i, label, v in rows], SCHEMA)
    return sorted(tuple(r) for r in h.mine_hard_negatives(df.repartition(3)).collect())


def clustered(n, dim, seed, spread, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    v = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dim))
    v *= scale * rng.lognormal(0, 0.5, (n, 1)) / np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, int(rng.integers(0, 4)), x.tolist()) for i, x in enumerate(v)]


def test_random_and_clustered_against_loops(spark):
    for rows in (clustered(700, 16, 1, 1.0), clustered(900, 24, 2, 0.2), clustered(400, 3, 3, 0.05)):
        want = by_hand(rows)
        assert len(want) > 60 and mined(spark, rows) == want


def test_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 160, int(rng.integers(0, 3)), rng.integers(-1, 2, 4).tolist()) for i in range(500)]
    rows += [(50, 1, [1, 1, 1, 1])] * 40 + [(100, None, [1, 1, 1, 1]), (None, 1, [1, 1, 1, 1]), (150, 1, None), (200, 1, [1, None, 1, 1]), (250, 1, [1, float("nan"), 1, 1]), (300, 1, [float("inf"), 1, 1, 1])]
    rows += [(350, 1, []), (351, 1, []), (352, 2, []), (400, 1, [0, 0, 0, 0]), (450, 2, [3, 2]), (451, 2, [3, 1]), (452, 1, [2, 2])]
    want = by_hand(rows)
    assert {r[0] for r in want} >= {0, 50, 350, 400, 450} and mined(spark, rows) == want


def test_large_components_and_long_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, (rng.standard_normal(3) * 10.0 ** rng.choice([0, 3, 7, 12, 150])).tolist()) for i in range(150)]
    assert mined(spark, rows) == by_hand(rows)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(50, 1, [1.0])]) == []


def test_blocks_and_buckets_change_nothing(spark, monkeypatch):
    rows = clustered(600, 12, 6, 0.3)
    want = by_hand(rows)
    for name, value in (("BLOCK_ANCHORS", 3), ("BUCKET_ROWS", 40), ("LEAST_ROWS", 10)):
        monkeypatch.setattr(h, name, value)
    assert mined(spark, rows) == want


def test_coordinates_prune_and_lose_nothing():
    """On rows in tight groups half of the rows are never multiplied out, and what is found is the best there is."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((200, 32))
    v = np.floor(256 * (centres[rng.integers(0, 200, 8000)] + 0.05 * rng.standard_normal((8000, 32))))
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    anchors = h.Anchors([{"uid": -1 - i, "vec_id": -1 - i, "label": 1, "q": v[i * 80]} for i in range(100)])
    best, made = h.Best(100, 5), 0
    for a in range(0, 8000, 500):
        own = v[a : a + 500]
        lists = np.argsort(h._unit(own, h._lengths(own)), axis=0, kind="stable").T.astype("<u2")
        ids = np.arange(a, a + 500)
        bucket = h.Bucket({"n": 500, "dim": 32, "kind": "<f8", "rows": own.tobytes(), "lists": lists.tobytes(), "labels": np.ones(500, np.int64).tobytes(), "ids": ids.tobytes(), "uids": ids.tobytes()})
        made += h.scan(bucket, anchors, True, np.full((100, 1), -h._LONG), np.full((100, 1), h._LONG), best)
    scores = (anchors.q @ v.T).astype(int)
    want = {(i, *sorted((-s, j) for j, s in enumerate(scores[i]))[k]) for i in range(100) for k in range(5)}
    assert {(s, -score, i) for s, score, i, _ in best.kept.T.tolist()} == want
    assert made < 0.55 * scores.size  # the first buckets, of which all rows are multiplied, included


def test_exact_products_of_large_integers():
    q = np.array([[2.0**40 + 1, 3.0], [5.0, 7.0]])
    row = {"n": 2, "dim": 2, "kind": "<f8", "rows": q.tobytes(), "lists": np.zeros((2, 2), "<u2").tobytes(), "labels": bytes(16), "ids": bytes(16), "uids": bytes(16)}
    assert h.Bucket(row).products(np.array([[2.0**21 + 1, 9.0]])).tolist() == [[(2**40 + 1) * (2**21 + 1) + 27, 5 * (2**21 + 1) + 63]]


def test_labels_move_where_sevens_divide(spark):
    rows = [(i, 9 if i % 7 == 0 else 0, [1.0, i / 100]) for i in range(101)]
    assert mined(spark, rows) == by_hand(rows) == []  # all labels are 0 then: no negatives
    df = spark.createDataFrame([(0, 1, [1.0])], "vec_id bigint, label int, embedding array<double>").withColumn("more", F.lit(1))
    assert h.mine_hard_negatives(df).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
