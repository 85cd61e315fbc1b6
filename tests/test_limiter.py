"""The limiter's batch form against a plain walk, and its stream against the batch form."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harborlight.streaming.limiter import admitted, decide, timed_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(seconds):
    return datetime(2024, 1, 1) + timedelta(seconds=seconds)


def plain(times, limit, window):
    out, held = [], []
    for t in times:
        held = [x for x in held if t - x <= window]
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_decisions_in_pieces(limit):
    rnd = random.Random(limit)
    times = sorted(rnd.randrange(3000) for _ in range(400))
    whole, pieces, held = decide(times, [], limit, 60)[0], [], []
    for i in range(0, 400, 37):
        done, held = decide(times[i : i + 37], held, limit, 60)
        pieces += done
    assert whole == pieces == plain(times, limit, 60)


def test_a_flooded_key_is_quick():
    began = time.time()
    out, _ = decide(list(range(1_000_000)), [], 3, 500_000)
    assert [i for i, x in enumerate(out) if x] == [0, 1, 2, 500_001, 500_002, 500_003] and time.time() - began < 2


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    yield
    spark.conf.set(key, before)


def run(spark, folder, name, **how):
    """The stream over the files in order, one a micro-batch."""
    stream = spark.readStream.schema("key string, ts timestamp, event_id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = timed_stream(stream, 2, 60, **how).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/state-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def put(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, ts timestamp, event_id long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(0.02)  # files are taken by their time


def test_stream_equals_batch_over_late_rows(spark, rocksdb, tmp_path):
    """Micro-batches bring requests up to 100 seconds late; what is later still is dropped."""
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(4)}", at(t), i) for i, t in enumerate(sorted(rnd.randrange(2000) for _ in range(240)))]
    late = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rnd.randrange(100)), r[2]))
    batches = [late[i : i + 60] for i in range(0, 240, 60)]
    dropped = ("k0", at(1), 900)  # comes last, far behind the watermark
    end = [("end", at(100_000), 901), ("end", at(200_000), 902)]
    put(spark, tmp_path, [*batches, [end[0]], [dropped, end[1]]])
    got = run(spark, tmp_path, "late_rows", lateness="100 seconds", shards=3)
    want = admitted(spark.createDataFrame(rows, "key string, ts timestamp, event_id long"), 2, 60)
    assert {(r.event_id, r.admitted) for r in got if r.event_id < 900} == {tuple(r) for r in want.collect()}
    assert not [r for r in got if r.event_id == 900]


@pytest.mark.parametrize("most,left", [(1000, 41), (5, 1)])
def test_idle_keys_are_purged_beyond_a_count(spark, rocksdb, tmp_path, most, left):
    """40 keys fall idle; the next decision purges them if there are too many."""
    put(spark, tmp_path, [[(f"k{i}", at(i), i) for i in range(40)], [("last", at(5000), 100)], [("end", at(9000), 101)], [("end", at(90000), 102)]])
    got = {r.event_id: r for r in run(spark, tmp_path, f"purged_{most}", lateness="1 second", shards=1, most=most)}
    assert got[100]["keys"] == left and all(r.admitted for r in got.values())
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state-purged_{most}").option("stateVarName", "held").load()
    keys = state.select(F.col("user_map_key.key")).distinct().count() if "user_map_key" in state.columns else state.count()
    assert keys == left + 1  # "end" came after the purge
