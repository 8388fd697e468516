"""Distributed union-find: alternating large-star and small-star steps on an edge table.

Each step is a minimum per node and a join of two written tables, so that adaptive execution can
split a hub's edges over tasks; no node's neighbours are gathered and nothing reaches the driver but
whether edges are left that are no stars.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import Scratch, drop_path, freed_shuffles


def _open(stars: DataFrame) -> bool:
    """Whether a node has two targets or is both child and target."""
    ends = stars.select("u", F.lit(1).alias("child")).unionByName(stars.select(F.col("v").alias("u"), F.lit(0).alias("child")))
    seen = ends.groupBy("u").agg(F.sum("child").alias("targets"), F.min("child").alias("least"))
    with freed_shuffles(stars.sparkSession):
        return not seen.where("targets > 1 or (targets = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """edges: a, b (any order, repeats and loops allowed) -> node, component (the smallest node); nodes without a partner are left out.

    Tables of earlier rounds are deleted; the last one stays, in `scratch` if given.
    """
    keep = scratch or Scratch(edges.sparkSession)
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    stars = keep.put(stars, "edges")
    while _open(stars):
        step = Scratch(edges.sparkSession)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = step.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = step.put(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old = keep.paths.pop()
        stars = keep.put(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        step.drop()
        drop_path(edges.sparkSession, old)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes by the edges i-j, of one task's bounded block."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        label = new[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    while (label[label] != label).any():
        label = label[label]
    return label
