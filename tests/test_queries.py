"""Every query with SQL against DuckDB; set TEST_QUERY_SF_DIR for a larger scale."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_QUERY_SF_DIR", "/root/testdata/sf0.001")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


#: Queries whose result has no rows at the small scale.
MAY_BE_EMPTY = set()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    found = compare(spark, con, SF_DIR, entry.queries()[name], ORACLE[name])
    assert found is None or (found == "EMPTY" and name in MAY_BE_EMPTY)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_clusters(spark):
    from pyspark.ml.linalg import Vectors

    from leadloom.operators import cluster as C

    rows = [(f"r{g}_{i}", float(10 * g + i % 3), 1.0 if g else 0.0, float(g), Vectors.dense([10.0 * g + i % 3, float(-g)])) for g in range(4) for i in range(20 + g)]
    scaled = spark.createDataFrame(rows, ["lead_key", "unified_score", "tier_weight", "source_count", "scaled"])
    scores = {r["k"]: r["silhouette"] for r in C.choose_k(scaled, starts=8).collect()}
    assert sorted(scores) == [3, 4, 5, 6] and max(scores, key=scores.get) == 4
    best = C.fit_best(scaled, starts=8).transform(scaled)
    assert sorted(r["count"] for r in best.groupBy("cluster_raw").count().collect()) == [20, 21, 22, 23]
    ranked = C.ranked_clusters(best).groupBy("cluster", "cluster_label").avg("unified_score").orderBy("cluster").collect()
    assert [r["cluster"] for r in ranked] == [0, 1, 2, 3] and [r[2] for r in ranked] == sorted(r[2] for r in ranked)
    assert C.with_persona(best).groupBy("cluster_raw").agg({"persona": "max"}).count() == 4
    assert C.silhouette(best.withColumn("cluster_raw", best["cluster_raw"] * 0)) == -1
