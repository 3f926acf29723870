"""Connected components of a link table, by joins and grouping only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep, written


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """Smallest node reachable from each node of links (a, b): rows (node, component).

    Each round gives a node the least of its label, its neighbours' labels and its
    label's label, until none changes: the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder,
    where the last one stays.
    Links may repeat and may be loops; without links there are no rows.
    """
    spark, before = links.sparkSession, set(written())
    both = keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), tag)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    labels = keep(labels, tag)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("was"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        own = labels.join(further, "label").select("node", F.col("further").alias("label"), F.col("label").alias("was"))
        after = keep(near.unionByName(own).groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was")), tag)
        labels = after.select("node", "label")
        *earlier, last = [p for p in written() if p not in before]
        if not after.where("label <> was").limit(1).count():
            drop(spark, earlier)
            return labels.withColumnRenamed("label", "component")
        # the links are needed in the next round, labels of earlier rounds are not
        drop(spark, earlier[1:])
