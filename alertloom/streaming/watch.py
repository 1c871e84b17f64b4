"""Findings over a stream of runs with typed state, event-time timers and forgetting, and the same over a whole log in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from alertloom.streaming.lifecycle import step

#: A finding that no run speaks of for so long is forgotten, and runs later than the watermark by so much are left out.
FORGET_S, LATE = 7 * 86400, "1 hour"
OUT = "fp string, run long, event string, state string"


class Findings(StatefulProcessor):
    """State of one finding: (state, runs present, runs absent, last run, its second). A timer at the last run's time and FORGET_S more clears
    it and says so, whether or not further runs come for that finding."""

    def __init__(self, forget_s: int = FORGET_S):
        self.forget_s = forget_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "state string, bad long, good long, run long, at_s long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, bad, good, last, at = self.held.get() if self.held.exists() else ("none", 0, 0, None, None)
        out = []
        for run, present, second in pd.concat(list(rows)).sort_values("run")[["run", "present", "at_s"]].itertuples(index=False):
            if last is not None and run <= last:
                continue  # a run that came again, or after one that followed it
            state, bad, good, event = step(state, int(bad), int(good), bool(present))
            last, at = int(run), int(second)
            if event:
                out.append((key[0], last, event, state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update((state, bad, good, last, at))
        self.handle.registerTimer((at + self.forget_s) * 1000)
        yield pd.DataFrame(out, columns=["fp", "run", "event", "state"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, _, _, last, _ = self.held.get()
        self.held.clear()
        yield pd.DataFrame([(key[0], int(last), "forgotten", state)], columns=["fp", "run", "event", "state"])

    def close(self) -> None:
        pass


def stream(log: DataFrame, forget_s: int = FORGET_S, late: str = LATE) -> DataFrame:
    """Transitions of findings from a stream of runs (fp, run, ts, present); the session needs the RocksDB state store."""
    d = log.withWatermark("ts", late).withColumn("at_s", F.unix_seconds("ts"))
    return d.groupBy("fp").transformWithStateInPandas(Findings(forget_s), OUT, "Append", "EventTime")


def replay(log: DataFrame, forget_s: int = FORGET_S, until_s: int | None = None) -> DataFrame:
    """The same of a whole log, in columns: a finding's runs cut where it is forgotten, each part folded as the stream folds it.

    A row is a run; parts begin after more than ``forget_s`` without one. The last part is forgotten too if ``until_s`` (the log's last second by
    default) is that far beyond.
    """
    w = Window.partitionBy("fp").orderBy("run")
    d = log.withColumn("at_s", F.unix_seconds("ts")).withColumn("gap", F.col("at_s") - F.lag("at_s").over(w))
    d = d.withColumn("part", F.sum(F.when(F.col("gap") > forget_s, 1).otherwise(0)).over(w))
    parts = d.groupBy("fp", "part").agg(F.array_sort(F.collect_list(F.struct("run", "present"))).alias("runs"), F.max("at_s").alias("last_s"), F.max("run").alias("last"))
    cell = lambda state, bad, good, out: F.struct(state.alias("state"), bad.alias("bad"), good.alias("good"), out.alias("out"))

    def one(a, x):
        bad, good = F.when(x["present"], a["bad"] + 1).otherwise(0), F.when(x["present"], F.lit(0)).otherwise(a["good"] + 1)
        event = F.when(x["present"] & (a["state"] == "none"), "new").when(x["present"] & (bad >= 2), F.when(a["state"] == "new", "opened").when(a["state"] == "resolved", "regressed"))
        event = F.coalesce(event, F.when(~x["present"] & a["state"].isin("open", "regressed") & (good >= 2), "resolved"))
        state = F.when(event == "new", "new").when(event == "opened", "open").when(event.isNotNull(), event).when(~x["present"] & (a["state"] == "new"), "none").otherwise(a["state"])
        said = F.struct(x["run"].alias("run"), event.alias("event"), state.alias("state"))
        return cell(state, bad, good, F.when(event.isNotNull(), F.array_append(a["out"], said)).otherwise(a["out"]))

    none = F.array().cast("array<struct<run:bigint,event:string,state:string>>")
    folded = parts.withColumn("a", F.aggregate("runs", cell(F.lit("none"), F.lit(0), F.lit(0), none), one))
    end = F.lit(until_s)
    later = F.lead("part").over(Window.partitionBy("fp").orderBy("part")).isNotNull()
    if until_s is None:
        folded = folded.join(F.broadcast(parts.agg(F.max("last_s").alias("end_s"))))
        end = F.col("end_s")
    gone = F.struct(F.col("last").alias("run"), F.lit("forgotten").alias("event"), F.col("a.state").alias("state"))
    folded = folded.withColumn("gone", later | (end - F.col("last_s") > forget_s))
    every = F.when(F.col("gone"), F.array_append(F.col("a.out"), gone)).otherwise(F.col("a.out"))
    return folded.select("fp", F.explode(every).alias("x")).select("fp", "x.run", "x.event", "x.state")
