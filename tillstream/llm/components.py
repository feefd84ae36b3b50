"""Connected components of a table of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.tables import forget, kept


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these. Edges have u > v."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): for each linked node the least node that it reaches, itself excluded from the rows if it is that."""
    edges = kept(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before = _mark(edges)
    while before[0]:
        old, edges = edges, kept(_small(_large(edges)), "links")
        forget(old)
        after = _mark(edges)
        if after == before:
            break
        before = after
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    out.kept_at = edges.kept_at  # so that it can be forgotten
    return out
