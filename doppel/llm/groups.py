"""Connected groups of a graph given by its links, and the dealing of candidate groups to tasks.

A group may hold a third of all rows, so no step gathers one: minima are combined before the shuffle, joins are left to the
adaptive skew handling, and members to be compared with each other are dealt to pairs of blocks.
"""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.checkpoint import settled

CELL = 2048  # members of small groups in one call


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def connected(links: DataFrame) -> DataFrame:
    """node, root: the least node of its connected group, for every node of a link.

    links: a long, b long, without nulls. Alternates two star steps, which hang the neighbours of a node to the least of them,
    until nothing changes; the number of rounds grows with the logarithm of the longest path.
    """
    spark = links.sparkSession
    now, links = settled(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    state = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours of a go to the least of a and its neighbours.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: smaller neighbours of a and a itself go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = settled(small)
        del both, least, large, small  # or their shuffle files stay
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        tidy(spark)
        if state == tuple(seen):
            break
        state = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def cells(members: DataFrame, group: str, node: str, block: int) -> DataFrame:
    """Members dealt so that any two of a group meet in exactly one cell: columns cell, side (0, 1, or 2 for both) are added.

    Groups of up to `block` members share cells of about CELL members; a larger group is cut into blocks by a hash, and each pair of
    its blocks is a cell. Members of a group of n are repeated about n / block times.
    """
    counts = members.groupBy(group).agg(F.count("*").alias("members"))
    total = counts.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    sized = members.join(counts, group).withColumn("blocks", F.ceil(F.col("members") / block))
    small = sized.where("blocks = 1").withColumn(
        "cell", F.concat(F.lit("s"), F.pmod(F.xxhash64(group), F.lit(total // CELL + 1)).cast("string"))).withColumn("side", F.lit(2))
    own = F.pmod(F.xxhash64(node), F.col("blocks"))
    large = (sized.where("blocks > 1").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .withColumn("cell", F.concat_ws("-", F.col(group).cast("string"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")))
             .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)).drop("own", "other"))
    return small.unionByName(large).drop("members", "blocks")


class Forest:
    """Union and find over positions; the root of a group is its first position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)
