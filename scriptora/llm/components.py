"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptora.llm.common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    Rounds of large-star and small-star turn the graph into stars; the edges
    never leave the cluster, each round is a written table, and a round's
    minimum is combined before the shuffle, so a node with very many neighbours
    costs its own task one row from each other. Loops and rows with nulls are
    ignored, repeated edges count once; no edges give no rows.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("u"), F.least(x, y).alias("v")]
    now = materialise(edges.where(F.col(a) != F.col(b)).select(*pair(F.col(a), F.col(b))).distinct(), "edges")
    mark = None
    while (seen := _mark(now)) != mark:
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that connect just what the edges i-j among n nodes connect."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    own = np.arange(n)
    return own[label != own], label[label != own]
