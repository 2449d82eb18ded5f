"""A map of items: two coordinates and a cluster for each vector."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layout(items: DataFrame, clusters: int = 8, seed: int = 1) -> DataFrame:
    """(asset_id, x, y, cluster) by principal components and k-means, stand-ins for a neighbour embedding and density clusters.

    Both are fitted by Spark over all rows; vectors of another length than the first component's are an error of Spark's.
    """
    rows = items.where("embedding is not null").select("asset_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    placed = PCA(k=2, inputCol="features", outputCol="place").fit(rows).transform(rows)
    grouped = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(placed)
    at = vector_to_array(F.col("place"))
    return grouped.select("asset_id", at[0].alias("x"), at[1].alias("y"), "cluster")
