"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every v in links (a, b): root is the smallest of its component.

    Each round hooks every root to its smallest neighbour, shortens the chains by pointer jumping and rewrites the links to
    roots; the number of roots with links at least halves, so rounds are logarithmic. Nothing but emptiness reaches the driver.
    """
    links = durable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if links.isEmpty():
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        hooks = durable(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("b")).select("v", F.least("v", "b").alias("up")), "hooks")
        moving = True
        while moving:  # four steps up at once
            twice = _up(hooks, hooks)
            jumped = durable(_up(twice, twice).join(twice.withColumnRenamed("up", "second"), "v").select("v", "up", (F.col("up") != F.col("second")).alias("moved")), "hooks")
            hooks, moving = jumped.select("v", "up"), not jumped.where("moved").isEmpty()
        roots = hooks.withColumnRenamed("up", "root") if roots is None else roots.join(hooks.select(F.col("v").alias("root"), "up"), "root", "left").select("v", F.coalesce("up", "root").alias("root"))
        a, b = hooks.select(F.col("v").alias("a"), F.col("up").alias("ra")), hooks.select(F.col("v").alias("b"), F.col("up").alias("rb"))
        links = durable(links.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
    return durable(roots, "roots")


def _up(low: DataFrame, high: DataFrame) -> DataFrame:
    """(v, up): from v as low says, and from there as high says."""
    return low.join(high.select(F.col("v").alias("up"), F.col("up").alias("upper")), "up").select("v", F.col("upper").alias("up"))
