"""Rate limits over event tables: an ordered fold for each key with state of bounded size.

Events are dealt by key and sorted in their partitions, then streamed through the fold batch by
batch, so a key with very many events takes no memory. Where no event comes for a whole window
nothing is held any more: keys with very many events are cut there and their stretches folded in
parallel. Keys go through as they are, null being a key like others.

One window over all events has no key to be dealt by. Its admissions follow from each other a whole
limit at a time, so they are found in waves over a table of places, and every event then reads its
wait from the admission before it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citemill.sources.store import stored

from .ranges import numbered, running

#: Keys with more events are cut where a window passes without one.
MANY_EVENTS = 1 << 20


class SlidingWindow:
    """At most ``limit`` events in ``window`` seconds; a refused event is not recorded."""

    def __init__(self, limit: int, window: float, held: list[float] | None = None):
        self.limit, self.window, self.held = limit, window, deque(held or ())

    def check(self, now: float) -> float:
        """0 if the event is let through, else the seconds to wait."""
        while self.held and now - self.held[0] >= self.window:
            self.held.popleft()
        if len(self.held) < self.limit:
            self.held.append(now)
            return 0.0
        return self.window - (now - self.held[0])

    def waits(self, times: list[float]) -> list[float]:
        """``check`` of times in order; runs of refused events are passed over at once."""
        out: list[float] = []
        while len(out) < len(times):
            wait = self.check(times[len(out)])
            out.append(wait)
            if wait:
                oldest = self.held[0]
                end = bisect_left(times, True, len(out), key=lambda t: t - oldest >= self.window)
                out += [self.window - (t - oldest) for t in times[len(out) : end]]
        return out


class TokenWindow:
    """At most ``limit`` tokens in 60 seconds, events of exactly that age still counted.

    An event is let through if its estimate, taken as ``limit`` at most, fits or nothing is held; it
    is held with all its tokens. Waits end a tenth of a second past the boundary.
    """

    def __init__(self, limit: int, window: float = 60.0):
        self.limit, self.window, self.held, self.used = limit, window, deque(), 0

    def check(self, now: float, tokens: int) -> float:
        while self.held and now - self.held[0][0] > self.window:
            self.used -= self.held.popleft()[1]
        if self.held and self.used + min(tokens, self.limit) > self.limit:
            return self.window - (now - self.held[0][0]) + 0.1
        self.held.append((now, tokens))
        self.used += tokens
        return 0.0


def _stretches(events: DataFrame, window: float) -> DataFrame:
    """events with ``stretch``: events of one key in different stretches lie a window apart at least.

    Time is cut into cells a window long, and a cell without an event parts stretches, so a key's
    stretches follow from its cells. Only keys with MANY_EVENTS have more than one.
    """
    many = events.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY_EVENTS).select(F.struct("key").alias("k_"))
    if many.isEmpty():
        return events.withColumn("stretch", F.lit(0).cast("bigint"))
    cell = F.floor(F.col("t") / (window + 1)).cast("bigint")
    keyed = events.withColumn("k_", F.struct("key")).withColumn("cell_", cell)
    cells = keyed.join(many, "k_", "left_semi").select("k_", "cell_").distinct()
    order = Window.partitionBy("k_").orderBy("cell_")
    fresh = (F.col("cell_") - F.lag("cell_").over(order) > 1).cast("bigint")
    named = cells.withColumn("fresh", F.coalesce(fresh, F.lit(0))).select("k_", "cell_", F.sum("fresh").over(order).alias("stretch"))
    return keyed.join(named, ["k_", "cell_"], "left").withColumn("stretch", F.coalesce("stretch", F.lit(0))).drop("k_", "cell_")


def _fold(events: DataFrame, window: float, out: str, make: Callable[[], Callable]) -> DataFrame:
    """events(key, id, t, ...) -> key, id, t and ``out``: make() gives a function from a run's columns but key and id to the new columns.

    It is called with successive parts of one key's events in order of time and id, and holds the state between them.
    """
    kinds = dict(events.dtypes)
    added = pa.schema([(c.split()[0], {"double": pa.float64(), "string": pa.string()}[c.split()[1]]) for c in out.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for batch in batches:
            keys, stretch = batch.column("key"), batch.column("stretch")
            n = batch.num_rows
            if not n:
                continue
            ends = sorted({*pc.run_end_encode(keys).run_ends.to_pylist(), *pc.run_end_encode(stretch).run_ends.to_pylist()})
            columns = [batch.column(c).to_pylist() for c in batch.schema.names if c not in ("key", "id", "stretch")]
            found: list[list] = [[] for _ in added]
            begin = 0
            for end in ends:
                key = (keys[begin].as_py(), stretch[begin].as_py())
                if step is None or key != current:
                    current, step = key, make()
                for column, values in zip(found, step(*(c[begin:end] for c in columns))):
                    column += values
                begin = end
            made = [pa.array(v, f.type) for v, f in zip(found, added)]
            yield pa.RecordBatch.from_arrays([keys, batch.column("id"), batch.column("t"), *made], ["key", "id", "t", *added.names])

    dealt = _stretches(events, window).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "t", "id")
    return dealt.mapInArrow(run, f"key {kinds['key']}, id {kinds['id']}, t double, {out}")


def _timed(events: DataFrame, *others: str) -> DataFrame:
    return events.select("key", "id", F.col("t").cast("double").alias("t"), *others)


def sliding_window(events: DataFrame, limit: int, window: float) -> DataFrame:
    """events(key, id, t seconds) -> (key, id, t, wait): wait is 0 where the event is let through. Ties go by id."""

    def make():
        limiter = SlidingWindow(limit, window)
        return lambda times: (limiter.waits(times),)

    return _fold(_timed(events), window, "wait double", make)


def token_window(events: DataFrame, limit: int) -> DataFrame:
    """events(key, id, t, tokens) -> (key, id, t, wait)."""

    def make():
        limiter = TokenWindow(limit)
        return lambda times, tokens: ([limiter.check(t, n) for t, n in zip(times, tokens)],)

    return _fold(_timed(events, F.col("tokens").cast("bigint").alias("tokens")), 60.0, "wait double", make)


#: Up to so many events one sliding window is folded in a single task; beyond, in waves.
SERIAL_EVENTS = 1 << 20
#: Admitted events that the driver gathers before it writes them.
GATHERED = 1 << 18


def _expiry(window: float) -> Callable:
    """Adds ``x``, the first time at which an event is a whole window old by the limiter's own arithmetic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t").to_numpy()
            x = t + window
            for _ in range(4):
                less = np.nextafter(x, -np.inf)
                x = np.where(less - t >= window, less, x)
            for _ in range(4):
                x = np.where(x - t >= window, x, np.nextafter(x, np.inf))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("t"), pa.array(x)], ["pos", "t", "x"])

    return run


def _steps(placed: DataFrame, window: float) -> DataFrame:
    """placed(pos, t) -> (pos, t, jump), by pos: jump is the place of the first event a window or more after."""
    ends = placed.select("pos", "t").mapInArrow(_expiry(window), "pos bigint, t double, x double")
    # Ends stand among the events, before those of the same time: the events before an end are its jump.
    both = ends.withColumn("event", F.lit(0)).unionByName(placed.select("pos", "t", F.col("t").alias("x"), F.lit(1).alias("event")))
    found = running(stored(both, "ends"), ["x", "event", "pos"], {"jump": ("event", "sum")}).where("event = 0")
    return stored(found.select("pos", "t", "jump").repartitionByRange("pos").sortWithinPartitions("pos"), "steps")


def _admitted(steps: DataFrame, n: int, limit: int) -> DataFrame:
    """(pos, oldest): the events that are let through, and the time of the oldest held one after each, null while there is room.

    A wave is as many admissions as the limit. The j-th of the next is the first event after the one
    before it that is no earlier than the jump of this wave's j-th, so all of a wave follow from a running maximum
    over the jumps of the wave before: a lookup of ``limit`` places for each window of time.
    """
    session = steps.sparkSession
    schema = "pos bigint, oldest double"
    written, gathered = None, []

    def write() -> DataFrame:
        own = stored(session.createDataFrame(gathered, schema), "admitted")
        return own if written is None else written.unionByName(own)

    def look(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = session.createDataFrame([(int(p),) for p in places], "pos bigint")
        own = steps.where(F.col("pos").between(int(places[0]), int(places[-1])))
        rows = sorted(tuple(r) for r in own.join(F.broadcast(wanted), "pos").select("pos", "t", "jump").collect())
        return np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)

    places = np.arange(min(limit, n))
    times, jumps = look(places)
    gathered += [(int(p), None) for p in places[:-1]] + [(int(places[-1]), float(times[0]) if len(places) == limit else None)]
    while len(places) == limit:
        i = np.arange(1, limit + 1)
        following = i + np.maximum(np.maximum.accumulate(jumps - i), places[-1])
        following = following[following < n]
        if not len(following):
            break
        before, places = times, following
        times, jumps = look(places)
        oldest = np.append(before[1:], times[0])[: len(places)]
        gathered += [(int(p), float(o)) for p, o in zip(places, oldest)]
        if len(gathered) >= GATHERED:
            written, gathered = write(), []
    return write() if gathered or written is None else written


def one_window(events: DataFrame, limit: int, window: float) -> DataFrame:
    """events(id, t) -> (id, t, wait): one sliding window over all events, in order of time and id.

    Beyond SERIAL_EVENTS no task gets more than a range of them, and the driver only ``limit`` places at a time.
    """
    if limit < 1:
        raise ValueError("a limit is 1 at least")
    own = stored(events.select("id", F.col("t").cast("double").alias("t")), "limited")
    n = own.count()
    if n <= SERIAL_EVENTS:
        return sliding_window(own.select(F.lit(0).alias("key"), "id", "t"), limit, window).drop("key")
    placed = stored(numbered(own, ["t", "id"]), "placed")
    passed = _admitted(_steps(placed, window), n, limit).withColumn("passed", F.lit(True))
    told = stored(placed.join(passed, "pos", "left"), "told")
    # The oldest held time never goes back: the last one told is the largest.
    known = running(told, ["pos"], {"held": ("oldest", "max")})
    return known.select("id", "t", F.when(F.col("passed"), 0.0).otherwise(window - (F.col("t") - F.col("held"))).alias("wait"))


SCOPES = ("user_minute", "user_day", "global_day")


def cascade(events: DataFrame, per_minute: int, per_day: int, global_day: int) -> DataFrame:
    """events(key, id, t) -> (key, id, t, wait, scope): user-minute, user-day, then the global day.

    A limiter that let an event through keeps it even if a later one refuses. The first two fold by
    user; what passes both meets the global limit (``one_window``).
    """

    def by_user():
        minute, day = SlidingWindow(per_minute, 60), SlidingWindow(per_day, 86400)

        def step(times):
            waits, scopes = [], []
            for t in times:
                wait, scope = minute.check(t), SCOPES[0]
                if not wait:
                    wait, scope = day.check(t), SCOPES[1]
                waits.append(wait)
                scopes.append(scope if wait else None)
            return waits, scopes

        return step

    mine = stored(_fold(_timed(events), 86400.0, "wait double, scope string", by_user), "by-user")
    # Ids are ordered before keys, as where a user's events are folded.
    everyone = one_window(mine.where("scope is null").select(F.struct("id", "key").alias("id"), "t"), global_day, 86400.0)
    scope = F.when(F.col("wait") > 0, SCOPES[2])
    everyone = everyone.select(F.col("id.key").alias("key"), F.col("id.id").alias("id"), "t", "wait", scope.alias("scope"))
    return mine.where("scope is not null").unionByName(everyone)
