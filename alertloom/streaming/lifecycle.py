"""The life of a finding across runs, in batch over a run log and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Runs in a row that a finding must be present to open, absent to resolve.
OPEN_RUNS, RESOLVE_RUNS = 2, 2
FLAPS, FLAP_S = 3, 86400
TRANSITIONS = "fp string, run long, event string, state string"


def step(state: str, bad: int, good: int, present: bool) -> tuple[str, int, int, str | None]:
    """(state, runs present, runs absent, event) after one run: new, open, resolved, and open again as regressed."""
    if present:
        bad, good = bad + 1, 0
        if state == "none":
            return "new", bad, good, "new"
        if state == "new" and bad >= OPEN_RUNS:
            return "open", bad, good, "opened"
        if state == "resolved" and bad >= OPEN_RUNS:
            return "regressed", bad, good, "regressed"
    else:
        bad, good = 0, good + 1
        if state == "new":
            return "none", bad, good, None
        if state in ("open", "regressed") and good >= RESOLVE_RUNS:
            return "resolved", bad, good, "resolved"
    return state, bad, good, None


def replay(log: DataFrame) -> DataFrame:
    """Transitions of every finding from a log (fp, run, present): one ordered group per finding, runs being few per finding."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        state, bad, good, out = "none", 0, 0, []
        for fp, run, present in pdf.sort_values("run")[["fp", "run", "present"]].itertuples(index=False):
            state, bad, good, event = step(state, bad, good, present)
            if event:
                out.append((fp, run, event, state))
        return pd.DataFrame(out, columns=["fp", "run", "event", "state"])

    return log.groupBy("fp").applyInPandas(one, TRANSITIONS)


def stream(log: DataFrame) -> DataFrame:
    """The same over a stream of runs: state is kept per finding between batches."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state, bad, good = held.get if held.exists else ("none", 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("run")
        for run, present in rows[["run", "present"]].itertuples(index=False):
            state, bad, good, event = step(state, bad, good, bool(present))
            if event:
                out.append((key[0], run, event, state))
        held.update((state, bad, good))
        yield pd.DataFrame(out, columns=["fp", "run", "event", "state"])

    return log.groupBy("fp").applyInPandasWithState(one, TRANSITIONS, "state string, bad long, good long", "append", "NoTimeout")


def flapping(transitions: DataFrame, key: str = "fp", at: str = "at_s") -> DataFrame:
    """Transitions that are at least the FLAPS-th of their finding within FLAP_S seconds."""
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-FLAP_S + 1, 0)
    return transitions.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("flapping", F.col("recent") >= FLAPS)


def hourly_counts(events: DataFrame, lag: str = "15 minutes") -> DataFrame:
    """Streaming cube: events per hour, rule and channel; an hour is final once the watermark, ``lag`` behind, has passed it."""
    return events.withWatermark("ts", lag).groupBy(F.window("ts", "1 hour"), "rule_id", "ls").agg(F.count(F.lit(1)).alias("n")).select(F.unix_seconds("window.start").alias("hour_s"), "rule_id", "ls", "n")


def deduped(events: DataFrame, lag: str = "15 minutes") -> DataFrame:
    """Streaming dedup sessions: the first alert of each fingerprint and tumbling quarter hour."""
    bucket = F.floor(F.unix_seconds("ts") / 900)
    return events.withWatermark("ts", lag).withColumn("bucket", bucket).dropDuplicatesWithinWatermark(["rule_id", "src", "ls", "bucket"])
