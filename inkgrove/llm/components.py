"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.plans.shared import cut


def _star(edges: DataFrame) -> DataFrame:
    """For each u of (u, v): the least of u and its v as m, beside every v. Always a sort-merge join: the driver holds no copy of a side, however small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least.hint("merge"), "u")


def _pairs_of(edges: DataFrame, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    """Two rows (u, v) of each row, from one scan."""
    both = F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (one, two)))
    return edges.select(F.explode(both).alias("_pair")).select("_pair.u", "_pair.v")


def _settled(edges: DataFrame) -> bool:
    """Whether every u of the table (u > v) has one v, which is no u itself: then v is the least node of its component."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.explode(ends).alias("_end")).groupBy("_end.node").agg(F.sum("_end.up").alias("up"), F.sum("_end.down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the cut table edges (u, v): label is the least node that links reach.

    Runs until every component is a star; each half of a step ends in a table in the shared folder, so that the driver plans and
    holds a few exchanges at a time. Hubs are aggregated map-side."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        large = cut(_star(_pairs_of(now, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        now = cut(_pairs_of(_star(large), ("v", "m"), ("u", "m")).where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
