"""Findings over a stream with timers against the batch replay: forgetting, runs that come again, a restart from the checkpoint."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from alertloom.streaming import watch

T0 = datetime(2026, 3, 2)
SCHEMA = "fp string, run long, ts timestamp_ntz, present boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def runs(spark, rows):
    return spark.createDataFrame([(fp, n, T0 + timedelta(days=n), p) for fp, n, p in rows], SCHEMA).selectExpr("fp", "run", "cast(ts as timestamp) ts", "present")


def test_stream_with_timers_is_the_batch_replay(rocks, tmp_path):
    spark = rocks
    a = [("a", n, c == "1") for n, c in enumerate("1101100110") if c != "-"]
    b = [("b", n, True) for n in (0, 1, 2)] + [("b", n, True) for n in (14, 15)]  # forgotten in between
    c = [("c", 0, True)]  # never seen again
    beat = [("beat", n, True) for n in range(0, 30)]  # time goes on
    rows = a + b + c + beat
    log = runs(spark, rows)
    batch = sorted(map(tuple, watch.replay(log, until_s=int((T0 - datetime(1970, 1, 1)).total_seconds()) + 29 * 86400 - 3600).collect()))
    assert ("b", 2, "forgotten", "open") in batch and ("c", 0, "forgotten", "new") in batch and ("b", 15, "opened", "open") in batch
    got = []
    for i, (lo, hi) in enumerate(((0, 4), (4, 11), (11, 20), (20, 29), (29, 30))):
        part = log.filter(f"run >= {lo} and run < {hi}")
        if i == 1:
            part = part.unionByName(log.filter("run = 3"))  # runs that are delivered twice
        part.coalesce(1).write.json(str(tmp_path / f"in/{i}"))
        s = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        # a new query each time goes on from the checkpoint of the one before
        q = watch.stream(s).writeStream.format("json").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.schema(watch.OUT).json(str(tmp_path / "out")).select("fp", "run", "event", "state").collect()))
    assert got == batch


def test_replay_of_nothing(spark):
    assert watch.replay(runs(spark, [("a", 0, True)]).limit(0)).collect() == []
