"""Connected components of a table of links, by alternating large and small stars; groups are only ever reduced to their least member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common
from sedge.llm.common import Scratch, saved

FILES = 16


def are_stars(edges: DataFrame) -> bool:
    """Whether every node above another is linked with one node only, which isn't above any."""
    end = lambda name, above: F.struct(F.col(name).alias("node"), F.lit(above).alias("above"), F.lit(1 - above).alias("below"))
    ends = edges.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below")).where("above > 1 or above = 1 and below = 1").count() == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) for every node of a link. Null ends and loops are left out."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where((F.col("u") != F.col("v")) & F.col("u").isNotNull() & F.col("v").isNotNull()).distinct()
    scratch = Scratch(links.sparkSession, "links")
    edges = scratch.save(pairs)
    # where links are few, one row a node is broadcast, and few files are written
    light = edges.count() <= common.LIGHT
    least_of = F.broadcast if light else lambda x: x
    while not are_stars(edges):
        # large star: neighbours above a node move to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least_of(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: neighbours below a node, and itself, move to the least of them
        moved = large.join(least_of(large.groupBy("u").agg(F.min("v").alias("m"))), "u")
        small = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        last, scratch = scratch, Scratch(links.sparkSession, "links")
        edges = scratch.save(small.coalesce(FILES) if light else small)
        last.clear()
    stars = saved(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "components")
    scratch.clear()
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
