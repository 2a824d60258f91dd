"""Connected components of an edge table, by rounds of hooking and contraction.

Each round every node takes its smallest neighbour as label, labels are followed once more,
and the edges are rewritten to labels; edges inside one label vanish. The graph shrinks by a
factor each round, nothing is gathered on the driver, and hubs are met only by minimum
aggregations (combined before the shuffle) and joins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import settle, unsettle


def local_components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node of its component; pairs are few enough for memory."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        old = label.copy()
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        np.minimum.at(label, old, label.copy())  # what a label's own node has learnt
        label = label[label]
        if (label == old).all():
            break
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable."""
    edges = settle(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        hooked = settle(hooked, "hooked")
        onward = hooked.select(F.col("node").alias("to"), F.col("to").alias("label"))
        step = settle(hooked.join(onward, "to").select("node", "label"), "step")
        unsettle(hooked)
        old = labels
        if labels is None:
            labels = step
        else:
            moved = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
            labels = settle(moved.select("node", F.coalesce("next", "label").alias("label")), "labels")
        at = {side: step.select(F.col("node").alias(side), F.col("label").alias(f"to_{side}")) for side in "ab"}
        rest = edges.join(at["a"], "a").join(at["b"], "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b")
        smaller = settle(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        unsettle(edges)
        if old is not None:
            unsettle(old)
            unsettle(step)
        edges = smaller
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("label").alias("component"))
