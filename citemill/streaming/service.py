"""The answer service as a stream: user limits as keyed state, the global limit, answers and log by micro-batch.

A micro-batch's rows are written under its number: the log line by line as JSON, the replies, and the
times that the global limit still holds. A batch that is run again, after a lost driver or executor,
finds its log whole and does nothing, or starts over from the times of the batch before and replaces
what it had written. So the log has one line a request, and with ``answering.Cached`` no prompt is paid for twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citemill.functions.text import user_hash
from citemill.operators import limits
from citemill.plans import service
from citemill.plans.assistant import Assistant
from citemill.sources.store import stored

DAY = 86400.0
_ROW = "id string, user string, channel string, t double, question string, wait double, scope string"


def user_limits(requests: DataFrame, rates: service.RateLimits, salt: str, forget: str = "2 days") -> DataFrame:
    """A stream of (user_id, id, t, question, channel) with the hashed user, wait and scope of the user's own limits.

    A user's state are the times that the minute and the day hold, ``per_minute`` and ``per_day`` at
    most; it goes when no request came for ``forget`` of the clock. No request is late: a batch's are
    folded in order of time and id, after those of the batches before.
    """
    quiet = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        minute_held, day_held = state.get if state.exists else ([], [])
        minute, day = limits.SlidingWindow(rates.per_user_per_minute, 60, list(minute_held)), limits.SlidingWindow(rates.per_user_per_day, DAY, list(day_held))
        rows = pd.concat(list(batches)).sort_values(["t", "id"], kind="stable")
        waits, scopes = [], []
        for t, refused in zip(rows["t"], rows["refused"]):
            wait, scope = 0.0, refused
            if refused is None:
                wait, scope = minute.check(t), limits.SCOPES[0]
                if not wait:
                    wait, scope = day.check(t), limits.SCOPES[1]
                scope = scope if wait else None
            waits.append(wait)
            scopes.append(scope)
        state.update((list(minute.held), list(day.held)))
        state.setTimeoutDuration(quiet)
        yield rows.assign(wait=waits, scope=scopes)[["id", "user", "channel", "t", "question", "wait", "scope"]]

    own = requests.select(
        F.col("id").cast("string").alias("id"), user_hash(F.col("user_id"), salt).alias("user"), F.col("channel").cast("string").alias("channel"),
        F.col("t").cast("double").alias("t"), "question", service.refused().alias("refused"),
    )
    return own.groupBy("user").applyInPandasWithState(step, _ROW, "minute array<double>, day array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


class Service:
    """Answers a stream of requests below ``path``: folders log, replies and held, with a part for each micro-batch."""

    def __init__(self, assistant: Assistant, path: str, rates: service.RateLimits = service.RateLimits(), salt: str = ""):
        self.assistant, self.path, self.rates, self.salt = assistant, path.rstrip("/"), rates, salt

    def start(self, requests: DataFrame, checkpoint: str, **trigger):
        """``trigger`` as ``DataStreamWriter.trigger`` takes it."""
        writer = user_limits(requests, self.rates, self.salt).writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        conf, name = requests.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
        before = conf.get(name)
        # States that time out by the clock would keep a stream in batches without rows, and availableNow would never end.
        conf.set(name, "false")
        try:
            return (writer.trigger(**trigger) if trigger else writer).start()
        finally:
            conf.set(name, before)

    def _files(self, spark: SparkSession):
        at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at

    def _held(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Times that the global limit held after the batch before."""
        files, at = self._files(spark)
        done = [int(x.getPath().getName().partition("=")[2]) for x in files.listStatus(at("held"))] if files.exists(at("held")) else []
        last = max((b for b in done if b < batch_id), default=None)
        return spark.createDataFrame([], "t double") if last is None else spark.read.schema("t double").parquet(f"{self.path}/held/batch={last}")

    def batch(self, rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        files, at = self._files(spark)
        if files.exists(at(f"log/batch={batch_id}/_SUCCESS")):
            rows.write.format("noop").mode("append").save()  # run again after all was written: only the users' states are made anew
            return
        own = stored(rows.withColumn("row", F.monotonically_increasing_id()), "micro-batch")
        held = stored(self._held(spark, batch_id), "held")
        latest = held.agg(F.max("t")).first()[0]
        # The limiter goes on from where it was: no request is before those that it let through.
        now = F.greatest(F.col("t"), F.lit(latest)) if latest is not None else F.col("t")
        fresh = own.where("scope is null").select(F.struct(F.lit(1).alias("new"), F.col("id").alias("name"), "row").alias("id"), now.alias("t"))
        before = held.select(F.struct(F.lit(0).alias("new"), F.lit(None).cast("string").alias("name"), F.monotonically_increasing_id().alias("row")).alias("id"), "t")
        checked = stored(limits.one_window(before.unionByName(fresh), self.rates.global_per_day, DAY), "global")
        passed = checked.where("wait = 0").select("t").orderBy(F.col("t").desc()).limit(self.rates.global_per_day)
        passed.write.mode("overwrite").parquet(f"{self.path}/held/batch={batch_id}")
        told = own.join(checked.where("id.new = 1").select(F.col("id.row").alias("row"), F.col("wait").alias("global_")), "row", "left")
        waits = F.coalesce("global_", F.lit(0.0))
        whole = told.withColumns({"scope": F.coalesce("scope", F.when(waits > 0, limits.SCOPES[2])), "wait": F.when(waits > 0, waits).otherwise(F.col("wait"))}).drop("global_")
        replies, log = service.respond(stored(whole, "admitted"), self.assistant)
        replies.write.mode("overwrite").parquet(f"{self.path}/replies/batch={batch_id}")
        log.write.mode("overwrite").option("ignoreNullFields", True).json(f"{self.path}/log/batch={batch_id}")  # its _SUCCESS ends the batch
        for old in [x.getPath() for x in files.listStatus(at("held"))]:
            if int(old.getName().partition("=")[2]) < batch_id - 1:
                files.delete(old, True)
