"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in ``links`` (a, b): the smallest id reachable.

    Links count in both directions; repeated links and loops do no harm; links with a null end are
    dropped. Every round takes the least label around each id and then the label's own label, so that
    the rounds grow with the logarithm of a component's width; each is written to the checkpoint folder.
    """
    sound = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = checkpoint(sound.select("a", "b").unionByName(sound.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(edges.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "id").select("id", "component", F.least("component", "near").alias("near"))
        own = labels.select(F.col("id").alias("near"), F.col("component").alias("far"))
        stepped = checkpoint(nearer.join(own, "near").select("id", F.least("near", "far").alias("component"), F.col("component").alias("was")))
        labels = stepped.select("id", "component")
        if stepped.filter("component < was").isEmpty():
            return labels
