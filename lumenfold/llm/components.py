"""Connected components of a table of links, by alternating large-star and small-star rounds.

Edge cases: links to oneself, repeated links and links both ways count as one or none; an empty table gives no rows; links with
a null end are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import shared_dir

MAX_ROUNDS = 60


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links u > v. Large star: each neighbour above u points to u's least; small star: each below (and u) does."""
    if small:
        sides = links
    else:
        sides = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    if small:
        joined = sides.join(least, "u")
        moved = joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    joined = sides.join(least.select("u", F.least("m", "u").alias("m")), "u").filter("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (of one ordered type). Returns u, root: the least member of u's component, for members but the root.

    Rounds double the reach of each least member, so few are needed; a checkpoint in the shared folder after each
    cuts lineage. Nothing but a checksum of each round comes to the driver.
    """
    shared_dir(links.sparkSession)
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = None
    for _ in range(MAX_ROUNDS):
        # All links of a finished component go straight to its root, so no u is also a v.
        now = _star(_star(now, small=False), small=True).checkpoint()
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select("u", F.col("v").alias("root"))
        mark = tuple(seen)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
