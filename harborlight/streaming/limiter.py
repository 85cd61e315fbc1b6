"""Sliding-window rate limiter that records admitted requests only.

Because a rejected request leaves no trace, a window count over all requests gives another answer:
a request is admitted unless the `limit`-th last admitted one of its key is still in the window. The
batch form walks each key's requests in time order, from one admitted request to the next.

`timed_stream` decides in event time, so that it gives the batch form's answer whatever the order in which
micro-batches bring the requests: a request waits in the state until the watermark has passed it,
which a timer tells, one for every `tick` of a shard that has requests. Keys are dealt to shards; a shard's state holds the
waiting requests (a list) and the admitted times of its keys (a map). Once it has more than `most`
keys, those whose window is over are purged. `admitted_stream` decides at once instead, for input
that is in order.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, StructField, StructType


def decide(times: list[int], held: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Decisions for ascending times, and the last admitted times, `limit` at most.

    From one admitted request to the next is one search, however many are rejected between them.
    """
    out, held, i = [False] * len(times), list(held), 0
    while i < len(times):
        if len(held) >= limit and times[i] - held[-limit] <= window:
            i = bisect_right(times, held[-limit] + window, i)
            continue
        out[i] = True
        held.append(times[i])
        i += 1
    return out, held[-limit:]


def decisions(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """key, t (microseconds), event_id, admitted of the requests with a key.

    Each task walks its sorted rows and holds the last admitted times of the key it is at, `limit`
    at most, however many requests a key has.
    """
    window = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            code, times, out = keys.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy().tolist(), []
            edge = [*np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist(), len(code)] if len(code) else []
            for a, b in zip(edge, edge[1:]):
                key = keys.dictionary[int(code[a])].as_py()
                if key != at:
                    at, held = key, []
                done, held = decide(times[a:b], held, limit, window)
                out += done
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], ["key", "t", "event_id", "admitted"])

    rows = requests.where("key is not null").select("key", F.unix_micros("ts").alias("t"), "event_id").repartition("key").sortWithinPartitions("key", "t", "event_id")
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("admitted", BooleanType())]))


def admitted(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """event_id, admitted of every request (key, ts, event_id). Rows without a key are exempt."""
    free = requests.where("key is null").select("event_id", F.lit(True).alias("admitted"))
    return decisions(requests, limit, seconds).select("event_id", "admitted").unionByName(free)


def last_admitted(requests: DataFrame, limit: int, seconds: int, most: int) -> DataFrame:
    """key, last: the keys that have state after the last request, with their last admitted time.
    Beyond `most` keys, those whose window is over are purged."""
    last = decisions(requests, limit, seconds).where("admitted").groupBy("key").agg(F.max("t").alias("last"))
    now = requests.agg(F.max(F.unix_micros("ts")).alias("now"))  # one row, as the next
    rows = last.join(F.broadcast(now)).join(F.broadcast(last.agg(F.count(F.lit(1)).alias("keys"))))
    return rows.where((F.col("keys") <= most) | (F.col("now") - F.col("last") <= seconds * 1_000_000)).select("key", F.timestamp_micros("last").cast("timestamp_ntz").alias("last"))


def decided_stream(spark: SparkSession, feed: DataFrame, path: str, **how) -> DataFrame:
    """Run `timed_stream` over all that the feed has now, with its state in path; event_id and
    admitted of every request that it has decided so far. The state has to be in RocksDB."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("event_id", "admitted").write.mode("overwrite").parquet(f"{path}/decided/batch={number}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        timed_stream(feed, **how).writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema("event_id long, admitted boolean").parquet(f"{path}/decided/*")


class Limiter(StatefulProcessor):
    """Of a shard: `waiting` requests, and `held`, the last admitted times by key."""

    def __init__(self, limit: int, seconds: int, most: int, tick: int):
        self.limit, self.window, self.most, self.tick = limit, seconds * 1_000_000, most, tick * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "key string, t long, event_id long")
        self.held = handle.getMapState("held", "key string", "times array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            if len(part):
                self.waiting.appendList(list(zip(part["key"].tolist(), part["t"].tolist(), part["event_id"].tolist())))
                for tick in (part["t"] // self.tick + 1).unique().tolist():
                    self.handle.registerTimer(tick * self.tick // 1000)  # timers have milliseconds
        yield pd.DataFrame({"event_id": [], "admitted": [], "keys": []}).astype({"event_id": "int64", "admitted": "bool", "keys": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed is due, so of the timers that fire together one has work
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((r[1], r[2], r[0]) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        due = [r for r in rows if r[0] < now]
        if due:
            left = [(k, t, i) for t, i, k in rows if t >= now]
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        by_key: dict[str, list[tuple[int, int]]] = {}
        for t, i, k in due:
            by_key.setdefault(k, []).append((t, i))
        ids, out = [], []
        for k, own in by_key.items():
            before = list(self.held.getValue((k,))[0]) if self.held.containsKey((k,)) else []
            done, held = decide([t for t, _ in own], before, self.limit, self.window)
            self.held.updateValue((k,), (held,))
            ids += [i for _, i in own]
            out += done
        n = self.purge(now) if due else 0
        yield pd.DataFrame({"event_id": pd.Series(ids, dtype="int64"), "admitted": pd.Series(out, dtype="bool"), "keys": pd.Series([n] * len(ids), dtype="int64")})

    def purge(self, now: int) -> int:
        """The number of keys with state, after a purge if there are over `most`."""
        last = {k[0]: v[0][-1] for k, v in self.held.iterator()}
        if len(last) > self.most:
            for k, t in list(last.items()):
                if now - t > self.window:
                    self.held.removeKey((k,))
                    del last[k]
        return len(last)

    def close(self) -> None:
        pass


def timed_stream(requests: DataFrame, limit: int, seconds: int, lateness: str = "10 minutes", shards: int = 64, most: int = 10_000, tick: int = 1) -> DataFrame:
    """event_id, admitted, keys (with state in the shard, then) of a stream of (key, ts, event_id).

    A request is decided once the watermark, `lateness` behind the latest, has passed the end of its
    `tick` (seconds); one that
    comes later than that is dropped, as by any operator of the stream. `most` keys a shard may
    stay idle. Rows without a key are exempt; add them to what this returns, they need no state.
    """
    rows = requests.where("key is not null").withWatermark("ts", lateness)
    rows = rows.select("ts", F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("t"), F.col("event_id").cast("long").alias("event_id"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    return rows.groupBy("shard").transformWithStateInPandas(Limiter(limit, seconds, most, tick), "event_id long, admitted boolean, keys long", "append", "EventTime")


def admitted_stream(requests: DataFrame, limit: int, seconds: int, forget: bool = True) -> DataFrame:
    """The same for a stream of (key, ts, event_id).

    Requests of one key have to arrive in time order across micro-batches, as from one gateway.
    forget: idle keys lose their state by a processing-time timeout, which keeps a query that
    runs all the time; leave it off for runs that end with the input.
    """
    window = seconds * 1_000_000

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["t", "event_id"])
        out, held = decide(rows["t"].tolist(), held, limit, window)
        state.update((held,))
        if forget:
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "admitted": out})

    rows = requests.select("key", F.unix_micros("ts").alias("t"), "event_id")
    return rows.groupBy("key").applyInPandasWithState(run, "event_id long, admitted boolean", "held array<bigint>", "append", "ProcessingTimeTimeout" if forget else "NoTimeout")
