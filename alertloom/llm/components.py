"""Connected components by minimum labels, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import stash, unstash


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable.

    Each round, an id takes the smallest label among its neighbours and itself, then the label of that label. Labels are combined
    before the shuffle, so an id of many links is no hot group. Rounds go with the logarithm of the longest path in practice.
    """
    both = stash(links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("id").alias("k"), F.col("label").alias("far"))
        step = stash(step.join(far, F.col("label") == F.col("k"), "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        unstash(labels)
        labels = step.select("id", "label")
        if not step.filter("label <> old").limit(1).count():
            unstash(both)
            return step.select("id", F.col("label").alias("component"))
