"""Clusters of vectors. A substitute, not the reference method: components of the graph of similar pairs."""

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import similarity


def threshold_clusters(vectors: DataFrame, least: float, smallest: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and cluster: the smallest key that pairs of at least `least` cosine reach; -1 for groups below `smallest`."""
    pairs = similarity.similar_pairs(vectors, least, key, vector)
    links = written(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "cluster-links")
    labels = written(vectors.select(F.col(key).alias("id"), F.col(key).cast("long").alias("label")), "cluster-labels")
    while True:
        # The least label of the neighbours, then that label's own: paths halve in each round.
        near = links.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = step.join(step.select(F.col("id").alias("label"), F.col("label").alias("root")), "label").select("id", F.col("root").alias("label"))
        new = written(jump, "cluster-labels")
        if new.join(labels.withColumnRenamed("label", "old"), "id").filter("label <> old").isEmpty():
            break
        labels = new
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    return labels.join(size, "label").select(F.col("id").alias(key), F.when(F.col("n") >= smallest, F.col("label")).otherwise(-1).alias("cluster"))


def bisecting(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """key and cluster 0..k-1."""
    df = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(df).transform(df).select(key, F.col("prediction").alias("cluster"))


def silhouette(vectors: DataFrame, clusters: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row with the mean silhouette (squared Euclidean distance) over members that are not noise; null below two clusters."""
    c = clusters.filter("cluster >= 0").select(key, F.col("cluster").cast("double").alias("prediction"))
    df = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features")).join(c, key)
    many = df.select("prediction").distinct().limit(2).count() > 1
    value = ClusteringEvaluator().evaluate(df) if many else None
    return vectors.sparkSession.createDataFrame([(value,)], "silhouette double")


def groups(clusters: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """Size and first members of each cluster, for its name; noise last."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(key)), 1, sample).alias("members"))


def depths(tree: DataFrame, most: int = 100) -> DataFrame:
    """Child and the number of its ancestors, most + 1 for those that have more or are their own ancestors; from child and
    parent, one of several being the least. A parent without a row of its own counts as an ancestor.

    Each round looks twice as far up: a node's farthest known ancestor gives its own, so seven rounds settle 100 levels."""
    now = tree.groupBy("child").agg(F.min("parent").alias("up")).select("child", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth"))
    now, reach = written(now, "tree"), 1
    while reach <= most and not now.filter("up is not null").isEmpty():
        far = now.select(F.col("child").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = now.filter("up is not null").join(far, "up", "left").select("child", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now, reach = written(now.filter("up is null").unionByName(step), "tree"), reach * 2
    return now.select("child", F.least("depth", F.lit(most + 1)).alias("depth"))


def levels(nodes: DataFrame, high: float = 0.89, middle: float = 0.88) -> DataFrame:
    """Nodes by their lambda."""
    return nodes.withColumn("level", F.when(F.col("lambda") > high, 3).when(F.col("lambda") > middle, 2).when(F.col("depth") > 0, 1).otherwise(0))
