"""Connected components of an edge table, without the driver or any one task seeing more than a share of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vedette.session import scratch, written


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches.

    Rounds of "take the smallest label among the neighbours" and "take the label of the label" until none
    changes; stars need two or three rounds, a path of length n about log n. All aggregates are minima, summed up
    before the shuffle, and the joins are plain equi-joins that Spark splits where a key is hot. Every round ends
    in a written table. Self loops are allowed; null ends are left out."""
    pairs = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    spark = edges.sparkSession
    with scratch(spark) as last:
        both = written(pairs.union(pairs.select("b", "a")).distinct(), "cc-edges")
        labels, done = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels"), False
        while not done:
            with scratch(spark) as keep:
                near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("near"))
                lower = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
                lower = written(lower, "cc-lower")
                jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
                labels = keep(written(lower.join(jump, "component").select("node", F.least("component", "further").alias("component"), "old"), "cc-labels"))
                done = labels.where("component <> old").isEmpty()
        last(labels)
    return labels.select("node", "component")
