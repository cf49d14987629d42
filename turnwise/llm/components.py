"""Connected components of an edge table by contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches.

    In each round every class that touches a smaller one hooks to the smallest
    such, and pointers are shortened once; classes only ever get smaller names,
    so that the last name of a class is its smallest node. Hubs are reduced by
    ``min`` with partial aggregation; joins on a hub can be split by AQE.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    labels = None
    while True:
        hook = e.groupBy("hi").agg(F.min("lo").alias("to"))
        jump = hook.select(F.col("hi").alias("mid"), F.col("to").alias("far"))
        hook = cut(hook.join(jump, hook["to"] == jump["mid"], "left").select("hi", F.coalesce("far", "to").alias("to")), "hook")
        if hook.isEmpty():
            break
        if labels is None:
            nodes = e.select(F.col("hi").alias("node")).union(e.select(F.col("lo").alias("node"))).distinct()
            labels = nodes.withColumn("label", F.col("node"))
        labels = cut(labels.join(hook, labels["label"] == hook["hi"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        one = hook.select("hi", F.col("to").alias("hi_to"))
        two = hook.select(F.col("hi").alias("lo"), F.col("to").alias("lo_to"))
        moved = e.join(one, "hi", "left").join(two, "lo", "left").select(F.coalesce("hi_to", "hi").alias("x"), F.coalesce("lo_to", "lo").alias("y"))
        e = cut(moved.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges")
    return labels if labels is not None else e.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
