"""The rule graph: which rules depend on which, and suppressions that hide too much."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.cuts import checkpointed

MAX_DEPTH = 64


def descendants(rules: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, rule, level): every rule below ``root`` along ``edges`` (parent, child), at its least level.

    An edge holds only if the parent was loaded first: ``rules`` is (rule, position). Rounds go level by level and stop when one
    finds nothing new; a cycle ends at the level it closes. Each level is written once.
    """
    pos = lambda n: rules.select(F.col("rule").alias(n), F.col("position").alias(f"p_{n}"))
    e = checkpointed(edges.join(pos("parent"), "parent").join(pos("child"), "child").filter("p_parent < p_child").select("parent", "child").distinct())
    front = checkpointed(e.select(F.col("parent").alias("root"), F.col("child").alias("rule"), F.lit(1).alias("level")))
    levels = [front]
    for level in range(2, depth + 1):
        step = front.select("root", F.col("rule").alias("parent")).join(e, "parent").select("root", F.col("child").alias("rule")).distinct()
        known = reduce(DataFrame.unionByName, levels)
        front = checkpointed(step.join(known, ["root", "rule"], "left_anti").filter("root <> rule").withColumn("level", F.lit(level)))
        if not front.limit(1).count():
            break
        levels.append(front)
    return reduce(DataFrame.unionByName, levels)


def audit(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """Issues of suppressing rules (level 0 or 1): no condition, a parent of high level, a correlation that they starve, a missing
    parent, no description, or several rules of one condition. ``rules`` is (rule, position, level, conditions, description)."""
    parents = edges.join(rules.select(F.col("rule").alias("parent"), F.col("level").alias("parent_level")), "parent", "left")
    top = parents.groupBy(F.col("child").alias("rule")).agg(F.max("parent_level").alias("parent_level"), F.count_if(F.col("parent_level").isNull()).alias("missing"))
    below = edges.groupBy(F.col("parent").alias("rule")).agg(F.count(F.lit(1)).alias("dependents"))
    same = rules.filter("level <= 1").groupBy("conditions").agg(F.count(F.lit(1)).alias("twins"))
    d = rules.filter("level <= 1").join(top, "rule", "left").join(below, "rule", "left").join(same, "conditions", "left")
    issues = F.array_compact(F.array(
        F.when(F.coalesce("conditions", F.lit("")) == "", "whole_rule"), F.when(F.col("parent_level") >= 10, "high_parent"), F.when(F.col("dependents") > 0, "breaks_correlation"),
        F.when(F.col("missing") > 0, "missing_parent"), F.when(F.coalesce("description", F.lit("")) == "", "no_description"), F.when((F.col("twins") > 1) & (F.coalesce("conditions", F.lit("")) != ""), "duplicate"),
    ))
    return d.select("rule", F.array_join(issues, ",").alias("issues"), F.size(issues).alias("n_issues"))


def trial_order(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, rule, nth, after): the order in which the children of a rule are tried, and how many come after each.

    Higher levels go first, level 0 before all others of full accuracy; a rule with ``accuracy`` 0 counts a hundredth. Equals go by
    ``position``. An edge holds only if the parent was loaded first; repeated edges count once.
    """
    rank = F.when(F.col("level") == 0, 99).otherwise(F.col("level")) * F.when(F.col("accuracy") == 0, 1).otherwise(100)
    r = rules.select(F.col("rule").alias("child"), "position", rank.alias("rank"))
    p = rules.select(F.col("rule").alias("parent"), F.col("position").alias("at"))
    d = edges.select("parent", "child").distinct().join(p, "parent").join(r, "child").filter("at < position")
    w = Window.partitionBy("parent")
    return d.select("parent", F.col("child").alias("rule"), F.row_number().over(w.orderBy(F.desc("rank"), "position", "child")).alias("nth"), F.count(F.lit(1)).over(w).alias("n")).select("parent", "rule", "nth", (F.col("n") - F.col("nth")).alias("after"))
