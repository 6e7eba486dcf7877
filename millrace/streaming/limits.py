"""Rate limits and windows over event streams."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import written

MINUTE, SECOND = 60_000_000, 1_000_000


def decided(times: list[int], minute: list[int], per_second: int, per_minute: int) -> list[bool]:
    """Which of the sorted times (microseconds) are accepted; minute holds the accepted ones of the last minute and is brought up to date."""
    held, out = deque(minute), []
    for t in times:
        while held and held[0] <= t - MINUTE:
            held.popleft()
        good = len(held) < per_minute and sum(1 for x in held if x > t - SECOND) < per_second
        if good:
            held.append(t)
        out.append(good)
    minute[:] = held
    return out


def limited(events: DataFrame, key: str, per_second: int, per_minute: int) -> DataFrame:
    """event_id, key and allowed: under the limit of accepted events in the last second and the last minute, by key, in time order.

    Rejected events don't count, so this is a sequential decision for each key. After a whole clock minute without an event of the key its
    state is empty, so the key's stretches between such minutes are decided apart; a key without one stays sequential, with a state of
    at most per_minute times. Events without a key or a time aren't decided: allowed is null.
    """
    import pandas as pd

    def decide(batches):
        last, minute = None, []
        for pdf in batches:
            ok = []
            at = pdf["at"].tolist()
            keys = list(zip(pdf[key].tolist(), pdf["stretch"].tolist()))
            i = 0
            while i < len(keys):
                j = i
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                if keys[i] != last:
                    last, minute = keys[i], []
                ok += decided(at[i:j], minute, per_second, per_minute)
                i = j
            yield pd.DataFrame({"event_id": pdf["event_id"], key: pdf[key], "allowed": ok})

    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    given = events.select("event_id", F.col(key).cast("long").alias(key), at).withColumn("clock", F.floor(F.col("at") / MINUTE))
    known = given.filter(F.col(key).isNotNull() & F.col("at").isNotNull())
    by_key = Window.partitionBy(key).orderBy("clock")
    # a row a key and minute, whatever the number of events
    minutes = known.select(key, "clock").distinct().withColumn("new", (F.col("clock") - F.lag("clock").over(by_key) > 1).cast("int"))
    minutes = minutes.select(key, "clock", F.sum(F.coalesce("new", F.lit(0))).over(by_key).alias("stretch"))
    dealt = known.join(minutes, [key, "clock"]).repartition(key, "stretch").sortWithinPartitions(key, "stretch", "at", "event_id")
    done = dealt.select("event_id", key, "at", "stretch").mapInPandas(decide, f"event_id long, {key} long, allowed boolean")
    return done.unionByName(given.filter(F.col(key).isNull() | F.col("at").isNull()).select("event_id", key, F.lit(None).cast("boolean").alias("allowed")))


def limited_stream(events: DataFrame, key: str, per_second: int, per_minute: int, late: str = "1 minute") -> DataFrame:
    """limited() on a stream: each key's accepted times of the last minute are its state, which goes when the watermark has passed it by a minute.

    Events of a key are decided in time order inside a batch, and batches as they come; events behind the watermark are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def decide(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        minute = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(["at", "event_id"])
        ok = decided(pdf["at"].tolist(), minute, per_second, per_minute)
        state.update((minute,))
        state.setTimeoutTimestamp(int(pdf["at"].max()) // 1000 + MINUTE // 1000)
        yield pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), key: pdf[key].to_numpy(), "allowed": ok})

    ts = F.col("ts").cast("timestamp").alias("ts")
    given = events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select("event_id", F.col(key).cast("long").alias(key), ts, F.unix_micros(ts).alias("at")).withWatermark("ts", late)
    return given.groupBy(key).applyInPandasWithState(decide, f"event_id long, {key} long, allowed boolean", "minute array<long>", "append", GroupStateTimeout.EventTimeTimeout)


@dataclass(frozen=True)
class Stage:
    """At most `limit` events within `window` microseconds, of all events or by key; an event just a window old still counts."""

    name: str
    limit: int
    window: int
    keyed: bool


#: Limits of all events, then by key, as they are unless one says otherwise.
STAGES = (Stage("global_second", 10, SECOND, False), Stage("global_minute", 100, MINUTE, False), Stage("key_second", 2, SECOND, True), Stage("key_minute", 30, MINUTE, True))


def passed(times: list[int], held: deque, limit: int, window: int) -> list[bool]:
    """Which of the sorted times a stage lets pass; held has the last `limit` times that it let pass, and is brought up to date."""
    out = []
    for t in times:
        # the limit-th last one that passed lies outside the window: then fewer than limit lie inside
        ok = limit > 0 and (len(held) < limit or held[0] < t - window)
        if ok:
            if len(held) == limit:
                held.popleft()
            held.append(t)
        out.append(ok)
    return out


def _stage(given: DataFrame, stage: Stage) -> DataFrame:
    """event_id, key, at and ok of the events (event_id, key, at) that reach a stage.

    A stage's sequence (of all events, or of a key) is cut wherever a whole clock window is empty, as its state is empty there. What is between two
    such windows is decided in order by one task, with a state of `limit` times: for the first stage those are all events of a stretch without
    a free window, for later ones only what earlier ones let pass, so many a window at most, however many events there are.
    """
    import pandas as pd

    keys = ["key"] if stage.keyed else []
    clocked = given.withColumn("clock", F.floor(F.col("at") / stage.window))
    # a row a window in use (and key): as many as the time span has windows, whatever the number of events
    used = clocked.select(*keys, "clock").distinct()
    in_order = Window.partitionBy(*keys).orderBy("clock")
    used = used.withColumn("new", (F.col("clock") - F.lag("clock").over(in_order) > 1).cast("int"))
    used = used.select(*keys, "clock", F.sum(F.coalesce("new", F.lit(0))).over(in_order).alias("stretch"))
    dealt = clocked.join(used, [*keys, "clock"]).select("event_id", "key", "at", "stretch").repartition(*keys, "stretch").sortWithinPartitions(*keys, "stretch", "at", "event_id")

    def decide(batches):
        last, held = None, deque()
        for pdf in batches:
            ok, at = [], pdf["at"].tolist()
            groups = list(zip(pdf["key"].tolist(), pdf["stretch"].tolist())) if stage.keyed else pdf["stretch"].tolist()
            i = 0
            while i < len(groups):
                j = i
                while j < len(groups) and groups[j] == groups[i]:
                    j += 1
                if groups[i] != last:
                    last, held = groups[i], deque()
                ok += passed(at[i:j], held, stage.limit, stage.window)
                i = j
            yield pdf[["event_id", "key", "at"]].assign(ok=ok)

    return dealt.mapInPandas(decide, "event_id long, key long, at long, ok boolean")


def cascaded(events: DataFrame, key: str, stages: tuple[Stage, ...] = STAGES, free: tuple[int, ...] = ()) -> DataFrame:
    """event_id, key and decision: allowed, or the name of the first stage that an event doesn't pass.

    Every stage counts what passes it, though a later stage may reject it. Events of a key in `free` are allowed and counted nowhere; events
    without a key meet only the stages of all events; those without a time aren't decided (null). Events of equal time go by event_id.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    given = written(events.select("event_id", F.col(key).cast("long").alias("key"), at.alias("at")), "events")
    apart = F.col("at").isNull() | F.coalesce(F.col("key").isin(*free), F.lit(False)) if free else F.col("at").isNull()
    out = given.filter(apart).select("event_id", "key", F.when(F.col("at").isNotNull(), "allowed").alias("decision"))
    left = given.filter(~apart)
    for stage in stages:
        meets = left.filter(F.col("key").isNotNull()) if stage.keyed else left
        done = written(_stage(meets, stage), "stage")
        out = out.unionByName(done.filter("NOT ok").select("event_id", "key", F.lit(stage.name).alias("decision")))
        others = left.filter(F.col("key").isNull()) if stage.keyed else left.filter("false")
        left = done.filter("ok").drop("ok").unionByName(others)
    return out.unionByName(left.select("event_id", "key", F.lit("allowed").alias("decision"))).withColumnRenamed("key", key)


def _decider(stages: tuple[Stage, ...], keyed: bool):
    """A processor for some stages of one sequence: each stage's last times are its state, which a timer removes once they are all too old."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Decider(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.states = [handle.getValueState(s.name, "times array<long>") for s in stages]

        def handleInputRows(self, key, rows, timers):
            pdf = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
            held = [deque(state.get()[0]) if state.exists() else deque() for state in self.states]
            decisions = pdf["decision"].tolist()
            for i, (at, who) in enumerate(zip(pdf["at"].tolist(), pdf["who"].tolist())):
                if not decisions[i] and (who or not keyed):
                    decisions[i] = next((s.name for s, h in zip(stages, held) if not passed([at], h, s.limit, s.window)[0]), "")
            for state, h in zip(self.states, held):
                state.update((list(h),))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(pdf["at"].max()) // 1000 + max(s.window for s in stages) // 1000 + 1)
            yield pdf.assign(decision=decisions)[["event_id", "who", "ts", "at", "decision"]]

        def handleExpiredTimer(self, key, timers, expired):
            for state in self.states:
                state.clear()
            yield from ()

        def close(self):
            pass

    return Decider()


def cascaded_stream(events: DataFrame, key: str, stages: tuple[Stage, ...] = STAGES, late: str = "1 minute") -> DataFrame:
    """cascaded() on a stream: event_id, key and decision. Stages of all events come before those by key.

    One task decides the first for all events of a batch, whose state is some last times; then every key's task those of its key. Events go in time
    order inside a batch, and batches as they come; those behind the watermark and those without a time are left out. The session's
    spark.sql.streaming.stateStore.providerClass must be RocksDB's.
    """
    ts = F.col("ts").cast("timestamp")
    given = events.filter(F.col("ts").isNotNull()).select("event_id", F.coalesce(F.col(key).cast("long").cast("string"), F.lit("")).alias("who"), ts.alias("ts"), F.unix_micros(ts).alias("at"), F.lit("").alias("decision"))
    schema = "event_id long, who string, ts timestamp, at long, decision string"
    out = given.withWatermark("ts", late)
    for keyed, by in ((False, F.lit(0)), (True, F.col("who"))):
        own = tuple(s for s in stages if s.keyed == keyed)
        if own:
            out = out.withColumn("group", by).groupBy("group").transformWithStateInPandas(_decider(own, keyed), schema, "Append", "EventTime", eventTimeColumnName="ts")
    return out.select("event_id", F.when(F.col("who") != "", F.col("who").cast("long")).alias(key), F.when(F.col("decision") == "", "allowed").otherwise(F.col("decision")).alias("decision"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and kind; on a stream, late events are dropped after the watermark."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        at = at.withWatermark("at", late)
    return at.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
