"""Clustering of vectors and the budgeted snapshot of a corpus."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.session import materialize

LEVELS = (None, 500, 300, 200, 100)


def kmeans(vectors: DataFrame, k: int, seed: int = 1, max_iter: int = 20) -> tuple[DataFrame, DataFrame]:
    """(assignments (id, cluster), centroids (cluster, center)) by seeded k-means."""
    v = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initMode="k-means||").fit(v)
    spark = vectors.sparkSession
    centers = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, center array<double>")
    return model.transform(v).select("id", F.col("prediction").alias("cluster")), centers


def to_array(col: str):
    return vector_to_array(F.col(col))


def snapshot(findings: DataFrame, clusters: DataFrame, budget: int = 50_000, levels: tuple[int | None, ...] = LEVELS) -> DataFrame:
    """(cluster, ord, id, line): findings (id, topic, finding, epoch) of clusters (id, cluster), cut to fit the budget of characters.

    The largest length of finding with which all fits is chosen from one aggregation that measures
    every level at once. If none fits, the shortest is used and the largest cluster loses its oldest
    finding until the rest fits; of clusters of one size the first by name loses first. What that
    leaves is found without dropping one by one: all clusters keep their newest findings up to a
    level, and of the next level the last clusters keep theirs. A line has five characters at least
    with its end, so only a fifth of the budget is ever ranked, whatever the corpus.
    """
    f = findings.join(clusters, "id")

    def line(level: int | None):
        text = F.coalesce("finding", F.lit(""))
        cut = text if level is None else F.when(F.length(text) > level, F.concat(F.substring(text, 1, level), F.lit("..."))).otherwise(text)
        return F.concat(F.lit("- "), F.coalesce("topic", F.lit("")), F.lit(": "), cut)

    sizes = f.agg(*(F.coalesce(F.sum(F.length(line(v)) + 1), F.lit(0)).alias(f"l{i}") for i, v in enumerate(levels)), F.count("*").alias("n")).first()
    fits = [i for i in range(len(levels)) if sizes[f"l{i}"] <= budget]
    chosen = levels[fits[0]] if fits else levels[-1]
    out = f.select("cluster", "id", "epoch", line(chosen).alias("line"))
    w = W.partitionBy("cluster").orderBy(F.desc("epoch"), "id")
    out = out.withColumn("ord", F.row_number().over(w))
    if not fits:
        most = max(1, budget // 5)
        size = (F.length("line") + 1).cast("long")
        near = materialize(out.filter(F.col("ord") <= most).withColumn("size", size), "snapshot")
        upto = F.sum("all").over(W.orderBy("ord").rowsBetween(W.unboundedPreceding, 0))  # ``most`` levels at most
        levels = near.groupBy("ord").agg(F.sum("size").alias("all")).withColumn("upto", upto).filter(F.col("upto") <= budget)
        full, used = levels.agg(F.coalesce(F.max("ord"), F.lit(0)), F.coalesce(F.max("upto"), F.lit(0))).first()
        edge = near.filter(F.col("ord") == full + 1).orderBy(F.desc_nulls_last("cluster")).limit(most)
        edge = edge.withColumn("upto", F.sum("size").over(W.orderBy(F.desc_nulls_last("cluster")).rowsBetween(W.unboundedPreceding, 0))).filter(F.col("upto") <= budget - used)
        out = near.filter(F.col("ord") <= full).drop("size").unionByName(edge.drop("size", "upto"))
    return out.select("cluster", "ord", "id", "line")
