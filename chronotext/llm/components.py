"""Connected components by alternating stars, as joins and aggregates over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.llm.shared import written

#: A node with more rows than this, and than one in SHARE of all edges, is a hub.
HUB, SHARE = 256, 10_000


def _with_least(rows: DataFrame, stars: DataFrame, edges: int) -> DataFrame:
    """``rows`` (u, v) with m, the smallest node beside u: ``stars`` (u, m, n) has it, and how many rows u has.

    Hubs are joined by a broadcast, so that no task reads all rows of one.  A hub has more than a ten-thousandth of the
    edges, so there are at most twenty thousand, whatever the number of edges.
    """
    hub = max(HUB, edges // SHARE)
    if edges <= hub:
        return rows.join(stars.select("u", "m").hint("shuffle_merge"), "u")
    hubs = stars.filter(F.col("n") > hub).select("u", F.col("m").alias("_m"))
    found = rows.join(F.broadcast(hubs), "u", "left")
    rest = found.filter("_m IS NULL").select("u", "v").join(stars.filter(F.col("n") <= hub).select("u", "m").hint("shuffle_merge"), "u")
    return found.filter("_m IS NOT NULL").select("u", "v", F.col("_m").alias("m")).unionByName(rest)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round hangs all larger neighbours of a node, then all smaller ones, on the smallest neighbour (the large-star and
    small-star steps of Kiveris et al., 2014), which takes about log n rounds.  Smallest neighbours come from partial
    aggregates, and the rows of hubs stay where they are (:func:`_with_least`), so a component of any size needs no large
    task.  Loops, null ends and repeated edges are allowed; an empty table gives an empty one.
    """
    ends = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    star = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        after = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before, n = after, after[0]
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        # Larger neighbours alone move, and those are the rows that run from the smaller end.
        large = _with_least(star.select(F.col("v").alias("u"), F.col("u").alias("v")), stars, n)
        large = written(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large") if n > HUB else large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        stars = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, stars, n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        star = written(small.distinct(), "stars")
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
