"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flaskmill.llm.texts import shared_rows


def _least(links: DataFrame) -> DataFrame:
    """u, m: least of a node and its neighbours, combined before the shuffle."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least one."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least one."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _least(links)
    near = links.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = m.select("u", F.col("m").alias("v"))
    return near.unionByName(own).where("u <> v").distinct()


def _settled(links: DataFrame) -> bool:
    """Every node has one link, to a node that has none."""
    several = links.groupBy("u").agg(F.count("*").alias("n")).where("n > 1")
    ends = links.select(F.col("v").alias("u")).distinct()
    return several.isEmpty() and links.join(ends, "u", "left_semi").isEmpty()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, root: for every node of a link (long ids) the least id of its component.

    The steps never gather a node's neighbours: they need the least one only, which is combined
    before the shuffle, so a node may have any number of links. Each round is written to the
    shared folder; the rounds end when all components are stars, after about log of the longest path.
    Links of a node to itself make it a component of its own; nulls are left out.
    """
    nodes = links.select(F.col(a).alias("id")).unionByName(links.select(F.col(b).alias("id"))).dropna()
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    now = shared_rows(now.distinct())
    while not _settled(now):
        now = shared_rows(_small_star(_large_star(now)))
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
