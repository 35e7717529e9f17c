"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrail.llm.shared import Store


def connected_components(links: DataFrame, store: Store) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it reaches.

    Each round replaces the links of a node by links to the smallest node of its neighbourhood;
    the number of links never grows, and rounds grow with the logarithm of the longest path. Hot
    nodes meet their minimum, one row, in a join that adaptive execution can split.
    """
    links = store.keep(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    before = None
    while True:
        mirrored = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = mirrored.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = (
            mirrored.join(least, F.col("a") == F.col("node"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest.withColumnRenamed("a", "node"), F.col("a") == F.col("node"))
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        links = store.keep(small)
        now = links.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    own = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own)
