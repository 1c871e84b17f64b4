"""Root causes of anomalies over the levels of the cube: tenant, source, agent, and the pair of both, resolved from the top down.

Input are anomalies (level, agent, source, status, onset_s, always_on) of status silent, drop or decay, and what they lack: the deficits
(level, agent, source, need) of the parents in their own windows, and (level, agent, source, by_agent, by_source, have) of the pairs in
the windows of their agent or source. Each step is a join that leaves alone what an earlier step has explained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.cuts import checkpointed
from alertloom.operators.habits import EXPLAINED, outage

#: What a quiet source may be before or after the others in an outage of all, and a drop, whose start is known to the hour.
SLACK_S, DROP_SLACK_S = 3600, 7200


def resolve(anomalies: DataFrame, need: DataFrame, have: DataFrame, monitored: DataFrame) -> DataFrame:
    """(level, agent, source, status, by) of every anomaly: by is "itself" for a root cause, "all" for an outage of all, else the name of what explains it (agent/,
    source/ or pair/).

    In this order: an agent whose deficit one anomalous channel carries alone is explained by it, if the agent has other channels
    (``monitored``: agent, channels). If so many other agents fell quiet together that all failed, or the tenant is silent, whatever began with
    them is explained by that. An agent left explains its channels. A source whose deficit the explained channels carry is explained
    by what explains the most of it; by its only channel left, if that carries it alone; else it explains its channels that are left. The tenant
    is explained if any other anomaly is a root cause. What is left is its own cause.
    """
    d = checkpointed(anomalies.select("level", "agent", "source", "status", "onset_s", "always_on"))
    pair = d.filter("level = 'pair'")
    carried_by = lambda level, k: have.filter(F.col("level") == level).join(need.filter(F.col("level") == level).select(k, "need"), k).filter("need > 0")
    # agents that one channel carries
    kids = pair.groupBy("agent").agg(F.count(F.lit(1)).alias("kids"), F.first("source").alias("only"))
    alone = carried_by("agent", "agent").select("agent", F.col("by_source").alias("only"), "need", "have").join(kids, ["agent", "only"]).filter((F.col("kids") == 1) & (F.col("have") >= EXPLAINED * F.col("need")))
    agents = d.filter("level = 'agent'").join(alone.select("agent", "only"), "agent", "left").join(monitored, "agent", "left").na.fill(0, ["channels"])
    agents = checkpointed(agents.withColumn("carried", F.col("only").isNotNull() & (F.col("status") != "silent")).withColumn("whole", ~F.col("carried") | (F.col("channels") < 2)))
    # an outage of all: the tenant's own silence, or many whole agents at once
    sudden = agents.filter("whole and status in ('silent', 'drop')").select(F.col("agent").alias("key"), F.col("onset_s").alias("at_s"), F.col("always_on").alias("steady"))
    many = outage(sudden, monitored.count()).filter("outage").agg(F.min("at_s").alias("lo"), F.max("at_s").alias("hi"))
    tenant = d.filter("level = 'tenant' and status = 'silent'").agg(F.min("onset_s").alias("t"))
    window = tenant.join(many).select(F.coalesce("t", "lo").alias("lo"), F.coalesce("t", "hi").alias("hi"))  # one row
    slack = F.when(F.col("status") == "silent", SLACK_S).when(F.col("status") == "drop", DROP_SLACK_S)
    d = d.join(F.broadcast(window)).withColumn("by", F.when((F.col("level") != "tenant") & F.col("onset_s").between(F.col("lo") - slack, F.col("hi") + slack), "all"))
    # agents: by their channel, or causes of their channels
    d = d.join(agents.select(F.lit("agent").alias("level"), "agent", F.when(F.col("carried"), F.concat(F.lit("pair/"), "agent", F.lit("/"), "only")).alias("channel")), ["level", "agent"], "left")
    d = checkpointed(d.withColumn("by", F.coalesce("by", "channel", F.when(F.col("level") == "agent", "itself"))).drop("channel"))
    above = d.filter("level = 'agent'").select("agent", F.col("by").alias("agent_by"))
    pairs = d.filter("level = 'pair'").join(above, "agent", "left")
    own = F.when(F.col("agent_by") == "all", "all").when(F.col("agent_by") == "itself", F.concat(F.lit("agent/"), "agent"))
    pairs = checkpointed(pairs.withColumn("by", F.coalesce("by", own)))
    # sources: by what explains their channels, by the only channel left, or causes of those
    share = carried_by("source", "source").select("source", F.col("by_agent").alias("agent"), "need", "have").join(pairs.select("agent", "source", F.col("by").alias("pair_by")), ["agent", "source"])
    owned = share.filter("pair_by is not null").groupBy("source", "need", "pair_by").agg(F.sum("have").alias("have"))
    owned = owned.groupBy("source", "need").agg(F.sum("have").alias("have"), F.min_by("pair_by", F.struct(-F.col("have"), "pair_by")).alias("owner")).filter(F.col("have") >= EXPLAINED * F.col("need"))
    left = share.filter("pair_by is null").groupBy("source", "need").agg(F.sum("have").alias("have"), F.count(F.lit(1)).alias("n"), F.first("agent").alias("one")).filter((F.col("n") == 1) & (F.col("have") >= EXPLAINED * F.col("need")))
    sources = d.filter("level = 'source'").join(owned.select("source", "owner"), "source", "left").join(left.select("source", "one"), "source", "left")
    sources = checkpointed(sources.withColumn("by", F.coalesce("by", "owner", F.when(F.col("one").isNotNull(), F.concat(F.lit("pair/"), "one", F.lit("/"), "source")), F.lit("itself"))))
    up = sources.select("source", F.col("by").alias("source_by"))
    pairs = pairs.join(up, "source", "left").withColumn("by", F.coalesce("by", F.when(F.col("source_by") == "itself", F.concat(F.lit("source/"), "source")).when(F.col("source_by") == "all", "all"), F.lit("itself")))
    cols = ["level", "agent", "source", "status", "by"]
    below = d.filter("level = 'agent'").select(cols).unionByName(sources.select(cols)).unionByName(pairs.select(cols))
    other = below.agg(F.count_if((F.col("by") == "itself") | (F.col("by") == "all")).alias("causes"))
    top = d.filter("level = 'tenant'").join(F.broadcast(other)).withColumn("by", F.when((F.col("status") == "silent") | (F.col("causes") == 0), "itself").otherwise("below"))
    return below.unionByName(top.select(cols))


