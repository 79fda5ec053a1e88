"""Results of the clustering queries, held by what is true of any right fit, at the default number of starts."""

import inspect
from collections import Counter, defaultdict

import __spark_entry__ as entry
from leadloom import dictionaries as D
from leadloom.operators import cluster as C

SF_DIR = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry.queries()[name](spark, SF_DIR).collect()


def test_clusters_of_profiles(spark):
    labelled = rows(spark, "ml3_clusters")
    ranked = rows(spark, "ml5_ranked_profiles")
    leads = {r["profile_key"] for r in rows(spark, "ml1_feature_matrix")}
    assert {r["profile_key"] for r in labelled} == leads == {r["profile_key"] for r in ranked} and len(labelled) == len(leads) == len(ranked)
    assert set(Counter(r["cluster_raw"] for r in labelled)) == {0, 1, 2}
    scores = defaultdict(list)
    for r in ranked:
        assert r["cluster_label"] == D.CLUSTER_LABELS[r["cluster"]]
        scores[r["cluster"]].append(r["unified_score"])
    means = [sum(scores[k]) / len(scores[k]) for k in range(3)]
    assert means == sorted(means)
    (k, value), = rows(spark, "ml4_silhouette_value")
    assert k == 3 and 0 < value <= 1


def test_clusters_of_leads(spark):
    leads = {r["lead_key"] for r in rows(spark, "ml6_feature_matrix_v3")}
    scores = {r["k"]: r["silhouette"] for r in rows(spark, "ml7_silhouettes")}
    assert sorted(scores) == [3, 4, 5, 6] and all(0 < v <= 1 for v in scores.values())
    labelled = rows(spark, "ml8_clusters")
    assert {r["lead_key"] for r in labelled} == leads and len(labelled) == len(leads)
    assert 3 <= len({r["cluster_raw"] for r in labelled}) <= 6
    personas = rows(spark, "ml9_persona_counts")
    counts = [next(v for k, v in r.asDict().items() if k != "persona" and isinstance(v, int)) for r in personas]
    assert {r["persona"] for r in personas} <= set(D.PERSONAS.values()) and len({r["persona"] for r in personas}) == len(personas)
    assert sum(counts) == len(leads)


def test_default_number_of_starts(spark):
    from pyspark.ml.linalg import Vectors

    assert inspect.signature(C.kmeans).parameters["starts"].default == 10 and inspect.signature(C.choose_k).parameters["starts"].default == 3
    points = [(g, Vectors.dense([10.0 * g + i % 3, float(-g)])) for g in range(4) for i in range(20 + g)]
    scaled = spark.createDataFrame(points, ["g", "scaled"])
    best = C.fit_best(scaled).transform(scaled)
    assert sorted(r["count"] for r in best.groupBy("cluster_raw", "g").count().collect()) == [20, 21, 22, 23]
