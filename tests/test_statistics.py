"""Percentiles, bootstrap intervals and threshold points whose groups are never gathered."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citemill.operators import bootstrap, metrics, quantiles, ranges, threshold


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- percentiles ----


def test_percentiles_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST_RANGE", 16)
    dice = random.Random(1)
    groups = {"a": [dice.choice([1.0, 2.0, 2.5, 7.0]) for _ in range(301)], "b": [dice.random() for _ in range(100)], None: [3.0, -1.0], "one": [5.0], "far": [1.0, float("inf")]}
    rows = [(g, v) for g, own in groups.items() for v in own] + [("a", None), ("none", None)]
    got = {r.grp: r for r in quantiles.percentiles(spark.createDataFrame(rows, "grp string, value double"), {"low": 0.0, "p": 0.3, "mid": 0.5, "p95": 0.95, "top": 1.0}).collect()}
    assert set(got) == set(groups)
    for g, own in groups.items():
        for name, p in (("low", 0), ("p", 0.3), ("mid", 0.5), ("p95", 0.95), ("top", 1)):
            if g == "far":  # numpy can't tell the largest of a group with an infinite value
                assert p not in (0, 1) or got[g][name] == own[p]
            else:
                assert got[g][name] == pytest.approx(np.percentile(own, 100 * p), abs=1e-12), (g, name)
    near = quantiles.percentiles(spark.createDataFrame(rows, "grp string, value double").where("grp = 'b'"), {"p": 0.95}, interpolate=False).first()
    assert near.p == sorted(groups["b"])[95]
    assert quantiles.percentiles(spark.createDataFrame([], "grp string, value double"), {"p": 0.5}).count() == 0


def test_costs_use_no_percentile_function(spark):
    rows = spark.createDataFrame([("c", float(i), 2.0, 1.0) for i in range(5)] + [(None, 1.0, None, 1.0)], "config string, latency_s double, tokens double, judge_tokens double")
    found = metrics.costs(rows)
    assert "percentile" not in executed(found).lower()
    assert {tuple(r) for r in found.collect()} == {("c", 2.0, 3.8, 2.0, 1.0), (None, 1.0, 1.0, None, 1.0)}


# ---- bootstrap ----


def drawn(key, b, seed=0):
    """How often a replicate draws a key, by the rule that the module states, in plain integers."""
    x = (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:8], 16) + b * bootstrap.STEP) % 2**32
    for shift, factor in bootstrap.MIX:
        x = (x ^ (x >> shift)) * factor % 2**32
    return sum(x >= least for least in bootstrap.DRAWN)


def test_intervals_by_hand(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "PART_ROWS", 7)  # groups in many parts
    dice = random.Random(2)
    groups = {"a": [dice.random() for _ in range(40)], None: [1.0, 0.0, 0.0], "same": [0.5] * 12, "one": [0.25]}
    rows = [(g, f"k{i}", v) for g, own in groups.items() for i, v in enumerate(own)] + [("a", "null", None)]
    for r in bootstrap.bootstrap_ci(spark.createDataFrame(rows, "grp string, key string, value double"), n_boot=200).collect():
        own, means = groups[r.grp], []
        for b in range(200):
            w = [drawn(f"k{i}", b) for i in range(len(own))]
            means.append(sum(x * v for x, v in zip(w, own)) / sum(w) if sum(w) else sum(own) / len(own))
        means.sort()
        assert (r.n, r.mean, r.low, r.high) == (len(own), pytest.approx(sum(own) / len(own), abs=1e-6), pytest.approx(means[5], abs=2e-6), pytest.approx(means[195], abs=2e-6))


def test_weights_are_poisson_and_unrelated():
    w = bootstrap.weights(np.random.default_rng(0).integers(0, 2**32, 4000), np.arange(500)).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.01
    assert [np.mean(w == k) for k in range(4)] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.003)
    assert np.abs(np.corrcoef(w[:40])[np.triu_indices(40, 1)]).max() < 0.25 and np.abs(np.corrcoef(w.T[:40])[np.triu_indices(40, 1)]).max() < 0.1


def test_intervals_of_a_million_values(spark):
    df = spark.range(10**6).select(F.lit("g").alias("grp"), F.col("id").alias("key"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("value"))
    found = bootstrap.bootstrap_ci(df, n_boot=400)
    assert "collect_list(value" not in executed(found)
    r = found.first()
    half = 1.96 * math.sqrt(1 / 12 / 10**6)
    assert abs(r.low - (r.mean - half)) < 0.2 * half and abs(r.high - (r.mean + half)) < 0.2 * half


def test_the_multinomial_interval_is_about_the_same(spark):
    dice = random.Random(4)
    rows = [("g", str(i), float(dice.random() < 0.7)) for i in range(120)]
    df = spark.createDataFrame(rows, "grp string, key string, value double")
    a, b = bootstrap.bootstrap_ci(df).first(), bootstrap.counted(df).first()
    assert a.mean == b.mean and abs(a.low - b.low) < 0.03 and abs(a.high - b.high) < 0.03


# ---- thresholds ----


def points_by_hand(rows, cap=0.1):
    scores = sorted({s for _, _, s in rows if s is not None})
    u, a = [r for r in rows if r[0] == "abstain"], [r for r in rows if r[0] != "abstain"]
    rate = lambda own, t: sum(gone or (t is not None and s is not None and s < t) for _, gone, s in own) / len(own) if own else 0.0
    every = [(t, rate(u, t), rate(a, t)) for t in [None, *scores, *[s + threshold.STEP for s in scores]]]
    order = sorted(range(len(every)), key=lambda i: (every[i][2] > cap, -round(every[i][1] - every[i][2], 12), i))
    return [every[i] for i in order]


def test_sweep_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST_RANGE", 20)
    dice = random.Random(6)
    for rows in ([(dice.choice(["abstain", "answer"]), dice.random() < 0.2, dice.choice([None, round(dice.uniform(-5, 5), 1), -9.0])) for _ in range(600)], [("answer", False, None)], [("abstain", True, 1.0)]):
        df = spark.createDataFrame(rows, "expected string, abstained boolean, score double")
        found = threshold.sweep(df)
        assert "SinglePartition" not in executed(found)
        got = [(r.threshold, r.correct_abstention, r.false_abstention) for r in found.orderBy("place").collect()]
        want = [(None if t is None else round(t, 7), round(c, 6), round(f, 6)) for t, c, f in points_by_hand(rows)]
        assert got == [pytest.approx(w) for w in want]
        best = threshold.best(df.withColumn("split", F.lit("dev"))).first()
        assert (best.threshold, best.correct_abstention, best.false_abstention, best.place) == (*got[0], 1)
