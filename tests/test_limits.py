import random

import pytest
from pyspark.sql import functions as F

from citemill.operators import limits, ranges
from citemill.plans import service
from citemill.streaming import usage


def test_sliding_window(spark):
    rows = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate((0, 1, 2, 61))] + [("b", 9, 2.0)], "key string, id int, t double")
    got = {(r.key, r.t): r.wait for r in limits.sliding_window(rows, 2, 60).collect()}
    assert got == {("a", 0.0): 0.0, ("a", 1.0): 0.0, ("a", 2.0): 58.0, ("a", 61.0): 0.0, ("b", 2.0): 0.0}


def test_token_window(spark):
    rows = spark.createDataFrame([("a", 0, 0.0, 900), ("a", 1, 10.0, 500), ("a", 2, 60.0, 500), ("a", 3, 60.5, 5000)], "key string, id int, t double, tokens int")
    got = [round(r.wait, 6) for r in limits.token_window(rows, 1000).orderBy("id").collect()]
    assert got == [0.0, 50.1, 0.1, 0.0]


def test_cascade_against_a_loop(spark):
    rng = random.Random(3)
    events = [(rng.choice("abc"), i, float(rng.randrange(2000)) * 60) for i in range(300)]
    minute, day, everyone, want = {}, {}, limits.SlidingWindow(40, 86400), {}
    for key, i, t in sorted(events, key=lambda e: (e[2], e[1])):
        for scope, limiter in (("user_minute", minute.setdefault(key, limits.SlidingWindow(1, 60))), ("user_day", day.setdefault(key, limits.SlidingWindow(20, 86400))), ("global_day", everyone)):
            if limiter.check(t):
                want[i] = scope
                break
    got = limits.cascade(spark.createDataFrame(events, "key string, id int, t double"), 1, 20, 40)
    assert {r.id: r.scope for r in got.where("scope is not null").collect()} == want and got.count() == 300


@pytest.mark.parametrize("limit, gaps", [(1, (0.0, 0.1, 7.0)), (5, (0.0, 0.3, 1.0)), (40, (0.0, 0.1, 0.2, 90.0)), (500, (0.1,))])
def test_waves_of_one_window_against_a_loop(spark, monkeypatch, limit, gaps):
    """Ties, fractions that doubles can't hold, quiet and busy times: waits are the loop's to the last bit."""
    dice, t, rows = random.Random(limit), 0.1, []
    for i in range(400):
        t += dice.choice(gaps)
        rows.append((dice.choice("ab"), i, t))
    monkeypatch.setattr(limits, "SERIAL_EVENTS", 0)
    monkeypatch.setattr(limits, "GATHERED", 64)
    monkeypatch.setattr(ranges, "LEAST_RANGE", 50)
    df = spark.createDataFrame([((k, i), x) for k, i, x in rows], "id struct<k:string,i:int>, t double")
    got = {tuple(r.id): r.wait for r in limits.one_window(df, limit, 10.0).collect()}
    one, want = limits.SlidingWindow(limit, 10.0), {}
    for x, k, i in sorted((x, k, i) for k, i, x in rows):
        want[k, i] = one.check(x)
    assert got == want
    assert limits.one_window(df.limit(0), limit, 10.0).count() == 0


def test_running_sums_and_maxima(spark, monkeypatch):
    monkeypatch.setattr(ranges, "LEAST_RANGE", 20)
    dice = random.Random(8)
    rows = [(dice.choice([None, "a", "b"]), dice.randrange(50), i, dice.choice([None, dice.random()])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v double")
    got = {r.i: (r.pos, r.top) for r in ranges.running(df.withColumn("one", F.lit(1)), ["o", "i"], {"pos": ("one", "sum"), "top": ("v", "max")}, ("g",)).collect()}
    for g, o, i, _ in rows:
        before = [v for h, p, j, v in rows if h == g and (p, j) < (o, i)]
        assert got[i] == (len(before), max((v for v in before if v is not None), default=None))


def test_requests_are_admitted_by_row(spark):
    ask = lambda *rows: spark.createDataFrame(rows, "user_id string, id string, t double, question string")
    got = service.admit(ask(("u", None, 1.0, "a"), ("u", None, 2.0, "b"), ("u", None, 3.0, "c"), ("v", "x", 1.0, "d"), ("w", "x", 1.0, "e"), ("w", "y", 2.0, "z" * 5000), ("w", "q", 2.0, None)), service.RateLimits(1, 30, 500)).collect()
    assert sorted((str(r.question)[:1], r.scope, r.wait) for r in got) == [
        ("N", "no_question", 0.0), ("a", None, 0.0), ("b", "user_minute", 59.0), ("c", "user_minute", 58.0), ("d", None, 0.0), ("e", None, 0.0), ("z", "too_long", 0.0)
    ]


def _drain(frame, tmp_path, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.to_timestamp_ltz("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    _drain(usage.per_window(stream), tmp_path, "windows", "complete")
    want = {tuple(r) for r in usage.per_window(events).collect()}
    assert {tuple(r) for r in spark.table("windows").collect()} == want
    _drain(usage.limit_stream(stream, 3, 86400.0), tmp_path, "limited")
    batch = limits.sliding_window(events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros("ts") / 1e6).alias("t")), 3, 86400)
    assert {(r.event_id, round(r.wait, 3)) for r in spark.table("limited").collect()} == {(r.id, round(r.wait, 3)) for r in batch.collect()}


def test_usage_log_round_trip(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"event":"answer","user":"u","total_s":1.5}\n\n{"event":"rate_limited","scope":"user_day"}\n')
    q = usage.write_usage(usage.read_usage(spark, str(tmp_path / "log")), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 2
