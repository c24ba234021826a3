"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowlens.session import drop_written, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node that can be reached.

    Each round points every node at its smallest neighbour, follows the pointers to their ends and keeps the links
    between different ends; at least half of the nodes go in each round. Hubs are split by AQE's skew join; the
    grouping on a hub is a minimum, which tasks combine before they shuffle. No links: no rows. Links with a null end
    are left out; repeated links and loops count once.
    """
    edges = written(
        links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges"
    )
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = written(nodes.withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        pointer = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "pointers")
        while True:
            ends = pointer.select(F.col("a").alias("to"), F.col("to").alias("end"))
            jumped = written(pointer.select("a", "to").join(ends, "to").select("a", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "pointers")
            drop_written(pointer)
            pointer = jumped
            if jumped.where("moved").isEmpty():
                break
        step = pointer.select("a", F.col("to").alias("end"))
        new_labels = written(
            labels.join(step, F.col("component") == F.col("a"), "left")
            .select("node", F.coalesce("end", "component").alias("component")), "labels"
        )
        left = edges.join(step, "a").select(F.col("end").alias("x"), "b")
        new_edges = written(
            left.join(step.withColumnRenamed("a", "b"), "b")
            .select(F.least("x", "end").alias("a"), F.greatest("x", "end").alias("b")).where("a <> b").distinct(), "edges"
        )
        drop_written(labels, edges, pointer)
        labels, edges = new_labels, new_edges
    drop_written(edges)
    # a round's ends are local minima, so the last end of a component is its smallest node
    return labels
