"""Coverage: what a host should send and doesn't, by its peers, by contract and against the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PEER_SHARE, MIN_PEERS = 0.9, 5
#: Lines of contracts at most; those of a host's platform are each held against its name.
MOST_CONTRACTS = 100_000


def peer_gaps(have: DataFrame, peers: DataFrame, share: float = PEER_SHARE) -> DataFrame:
    """(grp, host, source) of the sources that a host lacks though at least ``share`` of its peers send them.

    ``have`` is (host, source), ``peers`` (grp, host). Groups of fewer than MIN_PEERS hosts expect nothing. Expected sources of a
    group join its hosts by group, then what they have is taken away.
    """
    size = peers.groupBy("grp").agg(F.count_distinct("host").alias("hosts"))
    sent = peers.join(have, "host").groupBy("grp", "source").agg(F.count_distinct("host").alias("n"))
    expected = sent.join(size, "grp").filter((F.col("hosts") >= MIN_PEERS) & (F.col("n") / (F.col("hosts") - 1) >= share)).select("grp", "source", "n", "hosts")
    return peers.join(expected, "grp").join(have, ["host", "source"], "left_anti").select("grp", "host", "source", "n", "hosts")


def contract_states(contracts: DataFrame, hosts: DataFrame, stats: DataFrame, now: int, quiet_s: int, least: int) -> DataFrame:
    """State of every (contract, host, source): missing, silent, low or present.

    ``contracts`` is (contract, platform, name_like, source): a small theta side; ``hosts`` (host, platform); ``stats`` (host, source,
    n, last_s).
    """
    if contracts.limit(MOST_CONTRACTS + 1).count() > MOST_CONTRACTS:
        raise ValueError(f"more than {MOST_CONTRACTS} contracts")
    due = hosts.join(F.broadcast(contracts), hosts["platform"].eqNullSafe(contracts["platform"]) & F.col("host").like("%") & F.expr("host LIKE name_like")).select("contract", "host", "source")
    d = due.join(stats, ["host", "source"], "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.lit(now) - F.col("last_s") > quiet_s, "silent").when(F.col("n") < least, "low").otherwise("present")
    return d.select("contract", "host", "source", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def match_inventory(seen: DataFrame, inventory: DataFrame) -> DataFrame:
    """Hosts of the data with those of the inventory, in three passes, each partner used once: exact name, name in any case, short
    name where it is unambiguous on both sides. Returns (host, agent, how), one side null where there is no partner."""
    left, right = seen.select("host").distinct(), inventory.select("agent").distinct()
    out = None
    for how, key in (("exact", lambda c: F.col(c)), ("case", lambda c: F.lower(c)), ("short", lambda c: F.split(F.lower(c), r"\.")[0])):
        a = left.withColumn("k", key("host")).withColumn("na", F.count(F.lit(1)).over(Window.partitionBy("k")))
        b = right.withColumn("k", key("agent")).withColumn("nb", F.count(F.lit(1)).over(Window.partitionBy("k")))
        hit = a.join(b, "k").filter("na = 1 and nb = 1").select("host", "agent", F.lit(how).alias("how"))
        out = hit if out is None else out.unionByName(hit)
        left, right = left.join(hit, "host", "left_anti"), right.join(hit, "agent", "left_anti")
    return out.unionByName(left.select("host", F.lit(None).cast("string").alias("agent"), F.lit("data_only").alias("how"))).unionByName(right.select(F.lit(None).cast("string").alias("host"), "agent", F.lit("inventory_only").alias("how")))


def agent_states(agents: DataFrame, now: int, lost_s: int, stale_s: int) -> DataFrame:
    """never_connected, disconnected, stale, pending, no_data or ok, from (agent, status, keepalive_s, events)."""
    age = F.lit(now) - F.col("keepalive_s")
    state = F.when(F.col("keepalive_s").isNull(), "never_connected").when(age > stale_s, "stale").when(age > lost_s, "disconnected").when(F.col("status") == "pending", "pending").when(F.col("events") == 0, "no_data").otherwise("ok")
    return agents.select("agent", "status", "keepalive_s", "events", state.alias("state"))


def matrix(have: DataFrame, sources: list[str]) -> DataFrame:
    """Hosts by sources: events of each cell."""
    return have.groupBy("host").pivot("source", sources).agg(F.sum("n")).na.fill(0)


def usual_platform(seen: DataFrame) -> DataFrame:
    """Most frequent platform of each host; ties go to the first by alphabet."""
    c = seen.filter(F.col("platform").isNotNull()).groupBy("host", "platform").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("host").agg(F.min_by("platform", F.struct(-F.col("n"), "platform")).alias("platform"), F.sum("n").alias("n"))


def event_type_gaps(a: DataFrame, now: int, quiet_s: int, least: int = 20) -> DataFrame:
    """Event types of a host that used to come and stopped: at least ``least`` events, none for ``quiet_s``, though as many were due."""
    s = a.groupBy("src", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("ts")).alias("first_s"), F.unix_seconds(F.max("ts")).alias("last_s"))
    gap = F.lit(now) - F.col("last_s")
    due = F.col("n") * gap / F.greatest(F.col("last_s") - F.col("first_s"), F.lit(1))
    return s.select("src", "rule_id", "n", gap.alias("gap_s"), F.round(due, 6).alias("due"), ((F.col("n") >= least) & (gap >= quiet_s) & (due >= least)).alias("stopped"))
