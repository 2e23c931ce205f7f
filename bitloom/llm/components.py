"""Connected components of a table of links, as repeated joins.

Labels start as ids.  Each round every node takes the smallest label among its
neighbours and its own label's label (pointer jumping), so rounds grow with the
logarithm of a component's width on chains of labels.  Links are contracted to
their labels and inner links are dropped each round, so a star or a clique is done
after one round.  Every round is written to the shared folder, and deleted when the next
has replaced it; nothing is collected.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.store import drop, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has ``a`` and ``b``; returns ``node, label`` with the smallest node reachable.

    Self links are allowed (they add the node); repeated links don't matter.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # large step: each node's smallest neighbour, itself included
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "cc")
    edges = materialize(links.select("a", "b").where(F.col("a") != F.col("b")), "edges")
    while True:
        # contract: links between labels
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
        outer = edges.join(la, "a").join(lb, "b").where(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        outer = materialize(outer, "edges")
        if not outer.take(1):
            # labels of labels: a root is its own label
            while True:
                up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
                jumped = labels.join(up, "label").select("node", F.col("above").alias("label"), (F.col("above") != F.col("label")).alias("moved"))
                jumped = materialize(jumped, "cc")
                moved = jumped.where("moved").take(1)
                drop(labels)
                labels = jumped.select("node", "label")
                if not moved:
                    drop(edges)
                    drop(outer)
                    return labels
        # each label takes the smallest label linked to it; then pointers are followed once
        ends = outer.union(outer.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy(F.col("a").alias("label")).agg(F.min(F.least("a", "b")).alias("low"))
        before, labels = labels, materialize(labels.join(step, "label", "left").select("node", F.coalesce("low", "label").alias("label")), "cc")
        drop(before)
        drop(edges)
        edges = outer
