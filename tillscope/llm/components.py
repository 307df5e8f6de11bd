"""Connected components of a list of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.store import written


def _large_star(links: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest neighbour or itself."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    smaller = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = smaller.groupBy("u").agg(F.min("v").alias("m"))
    rest = smaller.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def _all_stars(links: DataFrame) -> bool:
    """Whether every node either hangs, once and with nothing on it, or hangs nowhere."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).union(
        links.select(F.col("v").alias("node"), F.lit(0).alias("hangs"))
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("links"))
    return not nodes.agg(F.expr("bool_or(hangs > 0 AND links > 1)")).first()[0]


def settled(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u and v, the smallest node that its links lead to, for every linked node but those v.

    ``links`` has columns u and v, any comparable type, either order, repeats and loops
    allowed; rows with a null are ignored. A round does a large-star and a small-star step,
    each an aggregation before the move and a join on a node, which can be split where a
    node has many links; each round's links are written, so nothing is computed twice and
    only one flag reaches the driver. Links that are stars already, such as an earlier
    result, take no round. Raises if the rounds do not suffice; they grow with the
    logarithm of the longest path.
    """
    clean = links.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = written(clean.distinct(), "links")
    for _ in range(most_rounds):
        if _all_stars(current):
            return current
        stars = _large_star(current).where("u <> v").distinct()
        current = written(_small_star(stars).where("u <> v").distinct(), "links")
    raise RuntimeError(f"links did not settle in {most_rounds} rounds")


def members(stars: DataFrame) -> DataFrame:
    """node and component of every node of the ``settled`` links."""
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component, the smallest node its links lead to, for every linked node.

    Nodes without a link to another do not appear; see ``settled``.
    """
    return members(settled(links, most_rounds))
