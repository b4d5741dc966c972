"""Connected components of an edge table, by rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicforms.llm.common import Workspace


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node at the smallest of them and itself: all greater ones, or all smaller ones."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionByName(turned) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Grouped first, then joined: a hub's neighbours are never gathered in one place.
    least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    pointed = near.join(least, "u")
    if large:
        return pointed.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    own = least.select("u", F.col("m").alias("v"))
    return pointed.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct()


def connected(edges: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(u, v): every node that is not the smallest of its component, and that smallest.  ``edges`` has long u and v."""
    current = space.write(edges.select("u", "v").where("u <> v").distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == mark or not state[0]:
            return current
        mark, step = state, step + 1
        current = space.write(_star(_star(current, True), False), f"{name}-{step}")
        space.drop(f"{name}-{step - 1}")
