"""Connected components of a link table, by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.shared import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    near = both.where("b > a").join(least, "a")
    return near.select(F.least("a", "m").alias("a"), "b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    near = links.join(least, "b").where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return near.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` but the roots; a root is the smallest node of its component.

    Links may repeat and may be in either direction; those of a node with itself, and with null, count for nothing. A
    busy node's minimum is taken before the shuffle, and the join that spreads it can be split, so no
    task holds all links of a node. Each round is written to the shared folder.
    """
    rows = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    now, last = stored(rows, "links"), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        last = seen
        now = stored(_small_star(_large_star(now)), "links")
