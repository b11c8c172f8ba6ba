"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long). Rows (id, component): for each linked id the smallest id that it reaches.

    Each round takes the least label of all neighbours, then that label's own label, so
    the rounds grow with the logarithm of the longest chain. A round is written before
    the next one reads it.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        owner = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        jumped = written(step.join(owner, "component", "left").select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")))
        labels = jumped.select("id", "component")
        if jumped.filter("old <> component").isEmpty():
            return labels
