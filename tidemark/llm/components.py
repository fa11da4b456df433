"""Connected components of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Links of a written file at most.
FILE_LINKS = 1 << 19


def _least_neighbour(links: DataFrame) -> DataFrame:
    """a and the least of a and all b that it is linked to; sums up before the shuffle."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least_neighbour(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least_neighbour(down)
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of all nodes of links(a, b), two longs.

    Stars are drawn to the least neighbour by turns among larger and among smaller nodes until
    nothing changes; the rounds grow with the logarithm of the longest chain. A round is written to
    the shared folder, so that it is neither computed twice nor lost."""
    now = stored(links.filter("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if state == before:
            break
        before = state
        # a round has no more links than the one before; small ones need few files
        now = stored(_small_star(_large_star(now)).coalesce(1 + state[0] // FILE_LINKS), "links")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
