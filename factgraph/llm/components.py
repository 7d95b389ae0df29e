"""Connected components of links by alternating large and small stars, with each round's links written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import dropped, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(links: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the smallest node that it sees, itself included."""
    near = _both_ways(links)
    low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return near.where("v > u").join(low, "u").select(F.col("low").alias("u"), "v").where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the smallest of them."""
    near = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("low"))
    hung = near.join(low, "u").select(F.col("low").alias("u"), "v").union(low.select(F.col("low").alias("u"), F.col("u").alias("v")))
    return hung.where("u <> v").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node either has others hanging on it or hangs on one node alone."""
    ends = links.select(F.col("u").alias("id"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")).union(links.select("v", F.lit(1), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every node of `links` (u, v: long, no nulls): label is the smallest id that it is connected with.

    Every round halves the depth of each tree at least; hub nodes cost what their links cost, as minima are summed
    before the shuffle and a join on a hub can be split.  Only whether all is settled reaches the driver.
    """
    now = stored(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    while not _settled(now):
        now, before = stored(_small(_large(now)), "links"), now
        dropped(before)
    roots = now.select("u").distinct().select(F.col("u").alias("id"), F.col("u").alias("label"))
    return now.select(F.col("v").alias("id"), F.col("u").alias("label")).union(roots)
