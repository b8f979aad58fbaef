"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import checkpointed


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Rows (node, root) for every node on an edge; root is the component's least node.

    Each round joins every node to the least node it knows of, so the rounds
    grow with the logarithm of the longest path.  All state is a table of at
    most one edge per node and link, checkpointed each round; only a row count
    and a checksum come to the driver.  Null ends are ignored.
    """
    star = checkpointed(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b and a is not null and b is not null").distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        star = checkpointed(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
