"""Root causes on small planted worlds: one channel, a whole host, a channel lost on many hosts, an outage of all."""

from __future__ import annotations

from alertloom.operators import hierarchy

LEVELS = "level string, agent string, source string"


def resolve(spark, anomalies, monitored, times=None):
    """``anomalies`` is {(agent, source): lack}; agents and sources are anomalous by their sums, with half of the lack needed."""
    times = times or {}
    found, need, have = [], [], []
    lack: dict[tuple, float] = {}
    for (a, s), n in anomalies.items():
        lack[("agent", a, None)] = lack.get(("agent", a, None), 0) + n
        lack[("source", None, s)] = lack.get(("source", None, s), 0) + n
        found.append(("pair", a, s, "silent", times.get(a, 1000), True))
        have += [("agent", a, None, a, s, float(n)), ("source", None, s, a, s, float(n))]
    for (level, a, s), n in lack.items():
        found.append((level, a, s, "drop", times.get(a, 1000), True))
        need.append((level, a, s, float(n)))
    d = spark.createDataFrame(found, f"{LEVELS}, status string, onset_s long, always_on boolean")
    n = spark.createDataFrame(need, f"{LEVELS}, need double")
    h = spark.createDataFrame(have, f"{LEVELS}, by_agent string, by_source string, have double")
    m = spark.createDataFrame(list(monitored.items()), "agent string, channels long")
    return {(r["level"], r["agent"], r["source"]): r["by"] for r in hierarchy.resolve(d, n, h, m).collect()}


MANY = {f"h{i}": 3 for i in range(20)}


def test_one_channel_of_a_host(spark):
    got = resolve(spark, {("h1", "sysmon"): 50}, MANY)
    assert got == {("agent", "h1", None): "pair/h1/sysmon", ("pair", "h1", "sysmon"): "itself", ("source", None, "sysmon"): "pair/h1/sysmon"}


def test_a_whole_host(spark):
    got = resolve(spark, {("h1", "sysmon"): 50, ("h1", "security"): 40}, MANY)
    assert got[("agent", "h1", None)] == "itself" and got[("pair", "h1", "sysmon")] == "agent/h1" and got[("source", None, "sysmon")] == "agent/h1"


def test_a_channel_lost_on_many_hosts(spark):
    got = resolve(spark, {(f"h{i}", "sysmon"): 10 for i in range(4)}, MANY)
    assert got[("source", None, "sysmon")] == "itself" and {got[("pair", f"h{i}", "sysmon")] for i in range(4)} == {"source/sysmon"}
    assert got[("agent", "h2", None)] == "pair/h2/sysmon"


def test_an_outage_of_all(spark):
    lost = {(f"h{i}", s): 10 for i in range(8) for s in ("a", "b")} | {("h9", "a"): 5, ("h9", "b"): 5}
    got = resolve(spark, lost, MANY, {"h9": 900_000, None: 1000})
    assert {got[("agent", f"h{i}", None)] for i in range(8)} == {"all"} and {got[("pair", f"h{i}", "a")] for i in range(8)} == {"all"}
    assert got[("agent", "h9", None)] == "itself" and got[("pair", "h9", "b")] == "agent/h9" and got[("source", None, "a")] == "all"


def test_nothing_wrong(spark):
    got = resolve(spark, {("h1", "a"): 1}, MANY)
    assert len(got) == 3
