"""Connected components by alternating large-star and small-star steps, each a join written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalume.llm.common import dropped, salted_join, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Large star: u's larger neighbours point to u's least neighbour. Small star: its smaller ones and itself do.

    The least neighbour is aggregated before the shuffle, and a node of very many edges
    meets it in several tasks. Also gives the table of least neighbours that the result reads.
    """
    own = edges.union(edges.select("v", "u").toDF("u", "v")) if large else edges
    least = own.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
    least = written(least.withColumn("m", F.least("u", "m")) if large else least, "least")
    joined = salted_join(own, least, ["u"], "__n", ["v"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots; a component's root is its least node.

    edges has two columns of the same comparable type; loops and rows with null are
    ignored, repeated edges count once. The number of steps follows the logarithm of the
    components' diameters.
    """
    edges = edges.toDF("u", "v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, before = written(edges, "edges"), None
    while True:
        step, first = _star(edges, True)
        middle = written(step, "edges")
        step, second = _star(middle, False)
        after = written(step, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (edges, middle, first, second):
            dropped(old)
        edges = after
        if now == before:
            return edges.toDF("node", "root")
        before = now
