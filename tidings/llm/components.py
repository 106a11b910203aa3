"""Connected components of a link table, by alternating large-star and
small-star steps. Each step is a partial aggregate (least neighbour per node)
and a join back. A node with a thousandth of all links or more has its least
neighbour broadcast (there are at most 1,000 such nodes), so its links stay where
they are: no task gathers the links of a hub. The link table and the
least neighbours are written to the shared folder in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import stored

#: A node with this share of all links is a hub.
HUB_SHARE = 1000


def _least(pairs: DataFrame) -> DataFrame:
    """node, least, links: for every node of pairs (a, b) the least of itself and its b."""
    return (pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("links"))
            .select("node", F.least("node", "low").alias("least"), "links"))


def _with_least(pairs: DataFrame, low: DataFrame) -> DataFrame:
    """a, b, least: pairs with the least neighbour of their a."""
    total = low.agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]
    hub = F.col("links") * HUB_SHARE >= F.lit(total)
    hubs, rest = low.filter(hub).select("node", "least"), low.filter(~hub).select("node", "least")
    on = F.col("a") == F.col("node")
    near = pairs.join(F.broadcast(hubs), on)
    far = pairs.join(F.broadcast(hubs.select("node")), on, "left_anti").join(rest, on)
    return near.unionByName(far).select("a", "b", "least")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stored(_least(both), "least")
    return (_with_least(both.filter(F.col("b") > F.col("a")), low)
            .select(F.col("b").alias("a"), F.col("least").alias("b")).filter(F.col("a") != F.col("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    low = stored(_least(down), "least")
    to_low = _with_least(down, low).select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = low.select(F.col("node").alias("a"), F.col("least").alias("b"))
    return to_low.unionByName(own).filter(F.col("a") != F.col("b")).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether distinct links (a, b), b < a, are stars already: no node has two
    links to lesser nodes, or links to lesser and greater ones. Partial aggregates."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 0 and down + up > 1").isEmpty()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """node, root (least node of its component) of every linked node but the
    roots. links: columns a, b of one orderable type."""
    now = stored(links.select("a", "b").filter(F.col("a") != F.col("b")), "links")
    for _ in range(rounds):
        now = stored(_small_star(_large_star(now)), "links")
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
