"""Keyed state: weighted sliding-window rate limits, handles that expire, counters; in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomspark.sources.shared import store

#: Points a key has in a window, the window, and what routes cost.
POINTS, WINDOW_SECONDS = 100, 300
COSTS = {"agent": 12, "answer": 4, "agent-parity": 4}
COUNTERS = ("compiles", "expands", "parity_runs", "agent_runs", "rate_limited", "conversion_failed", "llm_failover", "llm_all_failed")
HANDLE_SECONDS, PARITY_SECONDS, MOST_PARITY, MOST_KEYS = 30 * 60, 15 * 60, 200, 10_000


def request_cost(route: Column) -> Column:
    out = F.lit(1)
    for name, cost in COSTS.items():
        out = F.when(route.endswith(name), cost).otherwise(out)
    return out


class SlidingLog:
    """The admitted requests of one key; a refused one leaves no trace."""

    def __init__(self, entries: list[tuple[float, int]] | None = None, points: int = POINTS, window: float = WINDOW_SECONDS):
        self.entries, self.points, self.window = entries or [], points, window

    def ask(self, now: float, cost: int) -> tuple[bool, int]:
        """(allowed, points in use after it)"""
        self.entries = [(t, c) for t, c in self.entries if now - t < self.window]
        used = sum(c for _, c in self.entries)
        if used + cost > self.points:
            return False, used
        self.entries.append((now, cost))
        return True, used + cost


def walked(rows: DataFrame, by: list[str], order: list[str], schema, start: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """rows with what start()'s function adds to each, called in order within a key.

    A key's rows come sorted and in batches, so a task holds a batch and one key's state, however many rows the key has.
    """

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = object(), None
        for pdf in parts:
            added = []
            for row in pdf.to_dict("records"):
                key = tuple(row[c] for c in by)
                if key != at:
                    at, step = key, start()
                added.append(step(row))
            yield pd.concat([pdf, pd.DataFrame(added, index=pdf.index)], axis=1) if added else pdf.iloc[:0]

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(walk, schema)


def rate_limit(requests: DataFrame, points: int = POINTS, window: int = WINDOW_SECONDS) -> DataFrame:
    """requests (key, ts, route) with cost, allowed and used; a key's requests are judged by time, one after the other.

    A refusal changes what follows it, so a key is one sequential walk over sorted rows; its log holds at most `points` entries.
    """
    rows = requests.withColumn("cost", request_cost(F.col("route")))
    schema = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("used", T.IntegerType())])

    def start() -> Callable[[dict], dict]:
        log = SlidingLog(points=points, window=window)

        def step(r: dict) -> dict:
            allowed, used = log.ask(pd.Timestamp(r["ts"]).timestamp(), int(r["cost"]))
            return {"allowed": allowed, "used": used}

        return step

    return walked(rows, ["key"], ["ts", "route"], schema, start)


class RateLog(StatefulProcessor):
    """rate_limit for a stream: a key's admitted requests are a list that goes a window after the last of them."""

    def __init__(self, points: int, window: int):
        self.points, self.window = points, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "t double, cost int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(rows).sort_values(["ts", "route"], kind="stable")
        log = SlidingLog([(t, c) for t, c in self.log.get()] if self.log.exists() else [], self.points, self.window)
        seconds = _seconds(pdf["ts"])
        got = [log.ask(t, int(c)) for t, c in zip(seconds, pdf["cost"], strict=True)]
        if log.entries:
            self.log.put(log.entries)
        _one_timer(self.handle, timerValues, max(seconds) + self.window)
        yield pdf.assign(key=str(key[0]), allowed=[a for a, _ in got], used=pd.array([u for _, u in got], "int32"))[["key", "ts", "route", "cost", "allowed", "used"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.log.clear()
        yield from ()


def _seconds(ts: pd.Series) -> list[float]:
    return (ts - pd.Timestamp(0)).dt.total_seconds().tolist()


def _one_timer(handle: StatefulProcessorHandle, timers, seconds: float) -> None:
    """A key has one timer, at the latest time asked for and not before the watermark."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(max(int(seconds * 1000) + 1, timers.getCurrentWatermarkInMs() + 1))


def with_state(rows: DataFrame, by: str, processor: StatefulProcessor, out: str) -> DataFrame:
    """rows of a stream by key through a processor whose state is kept by RocksDB, which holds more of it than memory does."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(by).transformWithStateInPandas(processor, out, "Append", "EventTime")


def rate_limit_stream(requests: DataFrame, points: int = POINTS, window: int = WINDOW_SECONDS, late: str = "1 hour") -> DataFrame:
    """rate_limit over a stream.  Requests that come more than `late` behind the newest are left out."""
    rows = requests.select("key", F.col("ts").cast("timestamp").alias("ts"), "route").withWatermark("ts", late).withColumn("cost", request_cost(F.col("route")))
    return with_state(rows, "key", RateLog(points, window), "key string, ts timestamp, route string, cost int, allowed boolean, used int")


def live_handles(events: DataFrame, now: Column, seconds: int = HANDLE_SECONDS) -> DataFrame:
    """(handle, value, ts) that were stored last within the time; events (handle, value, ts)."""
    last = events.groupBy("handle").agg(F.max(F.struct("ts", "value")).alias("m")).select("handle", "m.value", "m.ts")
    return last.filter(F.col("ts") > now - F.expr(f"INTERVAL {seconds} SECONDS"))


def look_ups(events: DataFrame, seconds: int = HANDLE_SECONDS) -> DataFrame:
    """The look-ups of events (handle, kind 'store' or 'use', ts, value, and any others, which are kept): found, age in seconds and
    the value that was stored last, within the time; a store counts before a look-up of the same moment.

    Stores and look-ups are scanned together in order of time, by handle and stretch of `seconds`.  What was stored last in a
    stretch is handed to the next one, and what is older has expired, so a handle of very many events is many short scans.
    """
    stretch = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    rows = events.withColumns({"ts": F.col("ts").cast("timestamp")}).withColumn("stretch", stretch)
    stored = F.col("kind") == "store"
    last = rows.filter(stored).groupBy("handle", "stretch").agg(F.max(F.struct("ts", "value")).alias("held"))
    handed = last.select("handle", (F.col("stretch") + 1).alias("stretch"), F.lit("store").alias("kind"), F.col("held.ts").alias("ts"), F.col("held.value").alias("value"))
    scan = Window.partitionBy("handle", "stretch").orderBy("ts", "kind", "value").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(stored, F.struct("ts", "value")), ignorenulls=True).over(scan)
    read = rows.unionByName(handed, allowMissingColumns=True).withColumn("held", held).filter("kind = 'use'")
    age = (F.unix_micros("ts") - F.unix_micros("held.ts")) / 1e6
    found = F.coalesce(age <= seconds, F.lit(False))
    return read.withColumns({"found": found, "age": F.when(found, age), "value": F.when(found, F.col("held.value"))}).drop("stretch", "held", "kind")


class OneShot:
    """Entries that are handed out once: they go when they are used, after a time, or when there are too many, the oldest first."""

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds, self.stored = most, seconds, {}

    def store(self, handle, now: float) -> list:
        """Stores an entry; the (handle, time) of those that go for want of room."""
        self.stored.pop(handle, None)
        # Entries stand in the order of their times.
        while self.stored and now - (first := next(iter(self.stored.items())))[1] > self.seconds:
            del self.stored[first[0]]
        gone = []
        while len(self.stored) >= self.most:
            gone.append(next(iter(self.stored.items())))
            del self.stored[gone[-1][0]]
        self.stored[handle] = now
        return gone

    def use(self, handle, now: float) -> bool:
        at = self.stored.pop(handle, None)
        return at is not None and now - at <= self.seconds


#: Events of a slice of time, about.
SLICE_ROWS = 200_000


def one_shot(events: DataFrame, most: int = MOST_PARITY, seconds: int = PARITY_SECONDS, pool: str | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Uses of handles with their outcome: ok once after a store, gone before it, after that use, after the time, or when `most` others were stored since.

    events: (handle, kind 'store' or 'use', ts).  The bound holds for a pool (a column, such as the server that keeps the
    entries); without a pool all events are one.  At one moment stores come first.

    What a use or the time ends is told by a handle's own events.  What the bound ends is an order statistic: at each store the
    oldest entries beyond the `most` newest live ones go, so all that was stored up to some moment, which never moves back, is
    gone.  Time is cut into slices; each finds how far it moves that moment, from the entries that are live when it begins, and
    the farthest of the slices before it is added.
    """
    name = pool or "pool"
    base = (events if pool else events.withColumn("pool", F.lit(0))).select(F.col(name).alias("pool"), "handle", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")
    n_slices = max(1, -(-base.count() // slice_rows))
    span = seconds * 1_000_000
    cut = store(base.repartitionByRange(n_slices, "pool", "us").withColumns({"slice": F.spark_partition_id(), "stretch": F.floor(F.col("us") / span)}), "slices")
    # The event before and behind each, of its handle; one of another stretch but the neighbouring ones is too far to matter.
    event = F.struct("us", "kind", "slice")
    ends = cut.groupBy("pool", "handle", "stretch").agg(F.min(event).alias("first"), F.max(event).alias("last"))
    near = ends.select("pool", "handle", (F.col("stretch") + 1).alias("stretch"), F.col("last").alias("x")).union(ends.select("pool", "handle", F.col("stretch") - 1, F.col("first")))
    rows = cut.withColumn("own", F.lit(True)).unionByName(near.select("pool", "handle", "stretch", "x.us", "x.kind", "x.slice", F.lit(False).alias("own")), allowMissingColumns=True)
    scan = Window.partitionBy("pool", "handle", "stretch").orderBy("us", "kind")
    linked = rows.withColumns({"before": F.lag(event).over(scan), "behind": F.lead(event).over(scan)}).filter("own")
    linked = store(linked, "linked")

    # The entries that a slice begins with: of each earlier slice the newest live ones, at most as many as the bound.
    begins = cut.groupBy("pool", "slice").agg(F.min("us").alias("begins"))
    newest = Window.partitionBy("pool", "slice").orderBy(F.desc("us"), F.desc("handle"))
    left = linked.filter("kind = 'store' and (behind is null or behind.slice > slice)").withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= most)
    later = begins.select("pool", F.col("slice").alias("into"), "begins")
    held = left.join(later, "pool").filter((F.col("into") > F.col("slice")) & (F.col("begins") - F.col("us") <= span) & (F.col("behind").isNull() | (F.col("behind.slice") >= F.col("into"))))
    held = held.select("pool", F.col("into").alias("slice"), "handle", F.lit("held").alias("kind"), "us")
    kind = cut.schema["handle"].dataType

    def moved(pdf: pd.DataFrame) -> pd.DataFrame:
        """How far the bound has gone at each use, and at the end, in a slice of a pool."""
        entries, far, out = OneShot(most, span), None, []
        order = pdf.assign(k=pdf["kind"].map({"held": 0, "store": 1, "use": 2})).sort_values(["us", "k", "handle"], kind="stable")
        begins = order.loc[order["kind"] == "held"]
        entries.stored = dict(zip(begins["handle"].tolist(), begins["us"].tolist(), strict=True))
        for handle, kind, us in order.loc[order["kind"] != "held", ["handle", "kind", "us"]].itertuples(index=False, name=None):
            if kind == "store":
                for h, t in entries.store(handle, us):
                    far = (t, h) if far is None or (t, h) > far else far
            else:
                entries.use(handle, us)
                out.append((handle, us, *(far or (None, None))))
        out.append((None, None, *(far or (None, None))))
        done = pd.DataFrame(out, columns=["handle", "us", "far_us", "far_handle"], dtype="object")
        return done.assign(pool=pdf["pool"].iloc[0], slice=pdf["slice"].iloc[0])

    schema = T.StructType([cut.schema["pool"], T.StructField("slice", T.IntegerType()), T.StructField("handle", kind), T.StructField("us", T.LongType()), T.StructField("far_us", T.LongType()), T.StructField("far_handle", kind)])
    walks = cut.select("pool", "slice", "handle", "kind", "us").unionByName(held)
    walked_ = store(walks.groupBy("pool", "slice").applyInPandas(lambda pdf: moved(pdf)[schema.names], schema), "moved")
    # A row a slice and pool.
    before = Window.partitionBy("pool").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.when(F.col("far_us").isNotNull(), F.struct("far_us", "far_handle"))
    ends = walked_.filter("us is null").select("pool", "slice", F.max(reached).over(before).alias("start"))
    at_use = walked_.filter("us is not null").select("pool", "slice", "handle", "us", reached.alias("reached")).distinct().join(ends, ["pool", "slice"])
    uses = linked.filter("kind = 'use'").join(at_use, ["pool", "slice", "handle", "us"], "left")
    entry = F.struct(F.col("before.us").alias("far_us"), F.col("handle").alias("far_handle"))
    pushed = F.coalesce(entry <= F.col("start"), F.lit(False)) | F.coalesce(entry <= F.col("reached"), F.lit(False))
    ok = F.coalesce((F.col("before.kind") == "store") & (F.col("us") - F.col("before.us") <= span), F.lit(False)) & ~pushed
    return uses.select(*([F.col("pool").alias(pool)] if pool else []), "handle", "ts", F.when(ok, "ok").otherwise("gone").alias("outcome"))


class OneShotEntries(StatefulProcessor):
    """one_shot for a stream: a pool's entries are a map; they go when they are used, pushed out or expired."""

    def __init__(self, most: int, seconds: int):
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "handle string", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries = OneShot(self.most, self.seconds)
        was = {k[0]: v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        entries.stored = dict(sorted(was.items(), key=lambda x: (x[1], x[0])))
        pdf = pd.concat(rows).sort_values(["ts", "kind", "handle"], kind="stable")
        out = []
        for handle, kind, now in zip(pdf["handle"], pdf["kind"], _seconds(pdf["ts"]), strict=True):
            if kind == "store":
                entries.store(handle, now)
            out.append(None if kind == "store" else "ok" if entries.use(handle, now) else "gone")
        # Only what has changed is written.
        for h in was.keys() - entries.stored.keys():
            self.held.removeKey((h,))
        for h, t in entries.stored.items():
            if was.get(h) != t:
                self.held.updateValue((h,), (t,))
        if entries.stored:
            _one_timer(self.handle, timerValues, max(entries.stored.values()) + self.seconds)
        yield pdf.assign(pool=str(key[0]), outcome=out).loc[pdf["kind"] == "use", ["pool", "handle", "ts", "outcome"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield from ()


def one_shot_stream(events: DataFrame, most: int = MOST_PARITY, seconds: int = PARITY_SECONDS, late: str = "10 minutes") -> DataFrame:
    """one_shot over a stream of (pool, handle, kind, ts).  Events that come more than `late` behind the newest are left out."""
    rows = events.select(F.col("pool").cast("string").alias("pool"), F.col("handle").cast("string").alias("handle"), "kind", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return with_state(rows, "pool", OneShotEntries(most, seconds), "pool string, handle string, ts timestamp, outcome string")


class LiveHandle(StatefulProcessor):
    """When a handle was stored last; it goes after the time."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(rows).sort_values(["ts", "kind"], kind="stable")
        at = self.at.get()[0] if self.at.exists() else None
        found = []
        for kind, now in zip(pdf["kind"], _seconds(pdf["ts"]), strict=True):
            at = now if kind == "store" else at
            found.append(at is not None and now - at <= self.seconds)
        if at is not None:
            self.at.update((at,))
            _one_timer(self.handle, timerValues, at + self.seconds)
        yield pdf.assign(handle=str(key[0]), found=found).loc[pdf["kind"] == "use", ["handle", "ts", "found"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.at.clear()
        yield from ()


def live_handles_stream(events: DataFrame, seconds: int = HANDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Look-ups of a stream of handles (handle, kind 'store' or 'use', ts) with found; a handle's state goes `seconds` after its last store."""
    rows = events.select("handle", "kind", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return with_state(rows, "handle", LiveHandle(seconds), "handle string, ts timestamp, found boolean")


class BoundedKeys:
    """A map of keys to state with a bound: a new key drops the one that came first."""

    def __init__(self, most: int = MOST_KEYS):
        self.most, self.held = most, {}

    def put(self, key, value) -> None:
        if key not in self.held and len(self.held) >= self.most:
            del self.held[next(iter(self.held))]
        self.held[key] = value


def counters(events: DataFrame, name: str = "name", by: str | None = None) -> DataFrame:
    """Totals by name."""
    return events.groupBy(name).agg((F.sum(by) if by else F.count("*")).cast("long").alias("total"))


class RunCounters:
    """Counters of what jobs do, observed on their plans: rows are counted where they pass, and no event is written for them."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, Observation]] = []

    def watch(self, name: str, rows: DataFrame, by: Column | None = None) -> DataFrame:
        """rows that are counted, or summed up by a column, under a name when an action runs them."""
        seen = Observation()
        self.seen.append((name, seen))
        return rows.observe(seen, (F.count(F.lit(1)) if by is None else F.coalesce(F.sum(by), F.lit(0))).cast("long").alias(name))

    def totals(self) -> dict[str, int]:
        """Sums by name, of watched rows that an action has run; it waits for the last of them."""
        out: dict[str, int] = {}
        for name, seen in self.seen:
            out[name] = out.get(name, 0) + seen.get[name]
        return out


def session_totals(runs: DataFrame, by: str = "session", order: str = "ts") -> DataFrame:
    """Running sums of saved tokens and of their price over a session."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("saved_so_far", F.sum("tokens_saved").over(w)).withColumn("usd_so_far", F.sum(F.col("tokens_saved") / 1e6 * 3.0).over(w))
