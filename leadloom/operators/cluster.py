"""Clustering of profiles and contacts with Spark ML."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import text as T
from leadloom.operators.reports import top_values_code
from leadloom.session import staged

FEATURES = ["unified_score", "tier_code", "source_count", "has_email", "has_uid", "hot_total"]
FEATURES_V3 = ["unified_score", "tier_weight", "source_count", "source_weight", "province_code", "has_uid"]


def cluster_label(cluster: Column) -> Column:
    out = F.lit(D.UNCLUSTERED_LABEL)
    for number, label in D.CLUSTER_LABELS.items():
        out = F.when(cluster == number, F.lit(label)).otherwise(out)
    return out


def persona(unified: Column, tier_weight: Column, source_count: Column) -> Column:
    """Persona of a cluster centre."""
    p = D.PERSONAS
    return (F.when(unified > 65, p["hnw"]).when((unified > 45) & (tier_weight >= 0.8), p["business"])
            .when((unified > 40) & (source_count >= 2), p["cross"]).when(tier_weight >= 0.8, p["finance"])
            .when(source_count > 1.5, p["multichannel"]).otherwise(p["mass"]))


def features_v3(scored: DataFrame, province: str = "province_phone") -> DataFrame:
    """Six contact features; nulls are 0."""
    coded = top_values_code(scored, province, "province_code")
    return coded.select(
        "lead_key", F.coalesce("unified_score", F.lit(0.0)).alias("unified_score"),
        T.tier_weight(F.col("source_tier")).alias("tier_weight"),
        F.coalesce("source_count", F.lit(0)).cast("double").alias("source_count"),
        F.coalesce("source_weight", F.lit(0.0)).alias("source_weight"),
        F.col("province_code").cast("double").alias("province_code"),
        (F.coalesce("uid", F.lit("")) != "").cast("double").alias("has_uid"))


def impute_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """Median imputation and standard scaling into the vector ``scaled``."""
    filled = Imputer(strategy="median", inputCols=cols, outputCols=cols).fit(df).transform(df)
    vectors = VectorAssembler(inputCols=cols, outputCol="_raw").transform(filled)
    scaler = StandardScaler(inputCol="_raw", outputCol="scaled", withMean=True, withStd=True)
    return scaler.fit(vectors).transform(vectors).drop("_raw")


def scaled_table(features: DataFrame, cols: list[str]) -> DataFrame:
    """Scaled features as a written table: fitting reads them dozens of times."""
    return staged(impute_scale(staged(features, "features"), cols), "scaled")


def kmeans(scaled: DataFrame, k: int, starts: int = 10, seed: int = 42):
    """The model of the lowest cost of several starts, each over all rows of the table, which should be a written one."""
    models = [KMeans(k=k, seed=seed + i, initSteps=5, featuresCol="scaled", predictionCol="cluster_raw").fit(scaled)
              for i in range(starts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def silhouette(labelled: DataFrame) -> float:
    """Mean silhouette; -1 when all rows fell into one cluster."""
    if labelled.agg(F.min("cluster_raw") == F.max("cluster_raw")).first()[0]:
        return -1.0
    return ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster_raw").evaluate(labelled)


def ranked_clusters(labelled: DataFrame, by: str = "unified_score") -> DataFrame:
    """Cluster number 0.. in order of the mean score, and its label."""
    means = labelled.groupBy("cluster_raw").agg(F.avg(by).alias("_mean"))
    ranks = means.select("cluster_raw", (F.row_number().over(
        Window.partitionBy(F.lit(1)).orderBy("_mean", "cluster_raw")) - 1).alias("cluster"))
    return (labelled.join(F.broadcast(ranks), "cluster_raw")  # k rows
            .withColumn("cluster_label", cluster_label(F.col("cluster"))))


def choose_k(scaled: DataFrame, ks=(3, 4, 5, 6), starts: int = 3, seed: int = 42) -> DataFrame:
    """Silhouette per k over all rows; it needs one pass, as distances come from the clusters' sums."""
    scores = [(k, silhouette(kmeans(scaled, k, starts, seed).transform(scaled))) for k in ks]
    return scaled.sparkSession.createDataFrame(scores, "k INT, silhouette DOUBLE")


def fit_best(scaled: DataFrame, ks=(3, 4, 5, 6), starts: int = 3, seed: int = 42, final: int = 10):
    """The model, of ``final`` starts at least, for the k with the best silhouette, the smallest of equals."""
    scores = choose_k(scaled, ks, starts, seed).collect()
    k = max(scores, key=lambda r: (r["silhouette"], -r["k"]))["k"]
    return kmeans(scaled, k, max(starts, final), seed)


def with_persona(labelled: DataFrame) -> DataFrame:
    """Persona of each cluster from the unscaled mean of its rows (its centre)."""
    centres = labelled.groupBy("cluster_raw").agg(*[F.avg(c).alias(f"_{c}") for c in
                                                    ("unified_score", "tier_weight", "source_count")])
    names = centres.select("cluster_raw", persona(
        F.col("_unified_score"), F.col("_tier_weight"), F.col("_source_count")).alias("persona"))
    return labelled.join(F.broadcast(names), "cluster_raw")  # k rows


def scaled_values(scaled: DataFrame, cols: list[str]) -> DataFrame:
    """The scaled vector as one column per feature."""
    values = vector_to_array("scaled")
    return scaled.select("*", *[values[i].alias(f"z_{name}") for i, name in enumerate(cols)])
