"""K-means on whole numbers, against plain Python and against itself in other partitionings."""

import hashlib

import pytest
from pyspark.ml.linalg import Vectors

from leadloom.operators import kmeans as K

BATCHES = 8


def frame(spark, vectors, parts=3):
    rows = [(f"r{i:04d}", Vectors.dense(v)) for i, v in enumerate(vectors)]
    return K.points(spark.createDataFrame(rows, ["key", "scaled"]).repartition(parts), "key", BATCHES)


@pytest.fixture(scope="module")
def blobs(spark):
    """Four groups of different size and spread."""
    return [((i * 37 % 101) / 40 + 5 * (i % 4), (i * 53 % 97) / 30 - 4 * (i % 4 == 2)) for i in range(400)]


def plain(vectors):
    return [(f"r{i:04d}", tuple(int(x * K.UNIT + (0.5 if x >= 0 else -0.5)) for x in v)) for i, v in enumerate(vectors)]


def gap(p, q):
    return sum((a - b) ** 2 for a, b in zip(p, q, strict=True))


def label(p, centres):
    return min(range(len(centres)), key=lambda n: (gap(p, centres[n]), n))


def plain_seeds(rows, k, start):
    found = [min(rows, key=lambda r: (hashlib.md5(f"{start}:{r[0]}".encode()).hexdigest(), r[0]))[1]]
    while len(found) < k:
        found.append(min(rows, key=lambda r: (-min(gap(r[1], f) for f in found), r[0]))[1])
    return found


def plain_lloyd(rows, centres, iterations=20):
    for _ in range(iterations):
        groups = [[p for _, p in rows if label(p, centres) == n] for n in range(len(centres))]
        new = [tuple(K.rounded(sum(x), len(g)) for x in zip(*g, strict=True)) if g else old for g, old in zip(groups, centres, strict=True)]
        if new == centres:
            break
        centres = new
    return centres, sum(min(gap(p, m) for m in centres) for _, p in rows)


def plain_mini_batch(rows, k, epochs=3):
    batch = lambda key: int(hashlib.md5(key.encode()).hexdigest()[:6], 16) % BATCHES
    centres = plain_seeds([r for r in rows if batch(r[0]) == 0], k, 0)
    for _ in range(epochs):
        seen = [0] * k
        for b in range(BATCHES):
            part = [(label(p, centres), p) for key, p in rows if batch(key) == b]
            for n in range(k):
                own = [p for c, p in part if c == n]
                if own:
                    centres[n] = tuple(K.rounded(m * seen[n] + sum(x), seen[n] + len(own)) for m, x in zip(centres[n], zip(*own, strict=True), strict=True))
                    seen[n] += len(own)
    return centres


def test_steps_equal_plain_python(spark, blobs):
    rows, points = plain(blobs), frame(spark, blobs)
    assert K.seeds(points, 5, 2) == plain_seeds(rows, 5, 2)
    fits, costs = K.lloyd(points, (2, 4), starts=2)
    for (k, s), centres in fits.items():
        assert (centres, costs[k, s]) == plain_lloyd(rows, plain_seeds(rows, k, s))
    found = K.mini_batch(points, (3, 4), BATCHES)
    assert found == {k: plain_mini_batch(rows, k) for k in (3, 4)}
    assert {(r["key"], r["cluster_raw"], r["distance"]) for r in K.labelled(points, found[4]).collect()} == {
        (key, label(p, found[4]), gap(p, found[4][label(p, found[4])])) for key, p in rows}


def test_partitioning_changes_nothing(spark, blobs):
    once, other = (K.fit_best(frame(spark, blobs, parts), (3, 4), BATCHES) for parts in (1, 13))
    assert once == other


def test_mini_batch_costs_little_more_than_a_full_fit(spark, blobs):
    points = frame(spark, blobs)
    cost = lambda centres: K.labelled(points, centres).agg({"distance": "sum"}).first()[0]
    small = K.mini_batch(points, (4,), BATCHES)[4]
    assert cost(small) <= 1.05 * cost(K.fit(points, 4))


def test_silhouette_equals_pairwise_distances(spark, blobs):
    points, rows = frame(spark, blobs[:60]), plain(blobs[:60])
    centres = K.fit(points, 3)
    groups = [[p for _, p in rows if label(p, centres) == n] for n in range(3)]
    values = []
    for _, p in rows:
        own = label(p, centres)
        if len(groups[own]) == 1:
            values.append(0.0)
            continue
        mean = [sum(gap(p, q) for q in g) / (len(g) - (n == own)) for n, g in enumerate(groups)]
        a, b = mean[own], min(m for n, m in enumerate(mean) if n != own)
        values.append((b - a) / max(a, b))
    assert K.silhouettes(points, {3: centres})[3] == pytest.approx(sum(values) / len(values), abs=1e-8)


def test_few_equal_and_no_points(spark):
    same = frame(spark, [(1.0, 2.0)] * 5)
    centres = K.fit(same, 3)
    assert centres == [(10000, 20000)] * 3 and {r["cluster_raw"] for r in K.labelled(same, centres).collect()} == {0}
    assert K.silhouettes(same, {3: centres}) == {3: -1.0}
    pair = frame(spark, [(0.0, 0.0), (3.0, 4.0)])
    assert sorted(K.fit(pair, 2)) == [(0, 0), (30000, 40000)] and K.silhouettes(pair, {2: K.fit(pair, 2)}) == {2: 0.0}
    assert K.best_k({3: 0.5, 4: 0.5, 5: 0.1}) == 3
    none = frame(spark, [(0.0, 0.0)]).filter("false")
    assert K.fit(none, 3) == [] and K.fit_best(none) == ([], {})


def test_rounding_is_symmetric():
    assert [K.rounded(t, 2) for t in (-3, -1, 0, 1, 3, 4)] == [-2, -1, 0, 1, 2, 2]


def test_a_batch_reads_its_own_folder_only(spark, blobs):
    points = frame(spark, blobs)
    plan = points.filter("batch = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_a_step_has_no_code_of_its_own(spark, blobs):
    """Large centres and many fits leave the plan of a pass as it is: nothing grows past what the compiler takes, nothing is compiled anew."""
    points, plans = frame(spark, blobs), []
    for shift in (0, 1):
        fits = {k: [(i + shift, i) for i in range(k)] for k in (3, 4, 5, 6)}
        plan = K.silhouette_rows(points, fits)._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN" not in plan and "least(" not in plan
        plans.append(len(plan))
    assert plans[0] == plans[1] < 4000
    assert K.seeds_of(points, 4, range(3)) == {s: K.seeds(points, 4, s) for s in range(3)}


def test_sums_are_exact_past_64_bits(spark):
    far = frame(spark, [(150_000.0, 0.0)] * 3 + [(-150_000.0, 0.0)] * 2)
    assert K.sums(far, {(1, 0): [(0, 0)]}) == {(1, 0, 0): (5, [1_500_000_000, 0], 5 * 1_500_000_000 ** 2)}
    assert 5 * 1_500_000_000 ** 2 > 2 ** 63


def test_a_pass_is_one_stage_without_a_shuffle(spark):
    rows = spark.range(3000).selectExpr("CAST(id AS STRING) AS key", "id % 50 * 1000 AS x0", "id % 7 * 1000 AS x1", "0 AS batch").repartition(6)
    rows.write.mode("overwrite").parquet(path := K.new_dir(spark, "pass"))
    rows, tracker = spark.read.parquet(path), spark.sparkContext.statusTracker()
    centres = {(2, 0): [(0, 0), (40000, 3000)]}
    K.sums(rows, centres)
    spark.sparkContext.setJobGroup("pass", "k-means passes")
    try:
        found = K.sums(rows, centres)
        K.farthest(rows, {0: [(0, 0)]})
        jobs = tracker.getJobIdsForGroup("pass")
        assert [len(tracker.getJobInfo(j).stageIds) for j in jobs] == [1, 1]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(n for n, _, _ in found.values()) == 3000


@pytest.mark.parametrize("missing", [False, True])
def test_feature_points_equal_scaled_vectors(spark, missing):
    from leadloom.operators import cluster as C

    table = spark.range(400).selectExpr("CAST(id AS STRING) AS key", f"CASE WHEN id % 9 = 4 AND {missing} THEN NULL ELSE CAST(id % 13 AS DOUBLE) END AS a",
                                        "CAST(id % 5 AS DOUBLE) / 3 AS b", "1.0D AS c")
    rows = K.feature_points(table, ["a", "b", "c"], "key", 4, ["a"])
    want = {r["key"]: tuple(r)[1:] for r in K.points(C.impute_scale(table, ["a", "b", "c"]), "key", 4).collect()}
    got = {r["key"]: (r["x0"], r["x1"], r["x2"], r["batch"]) for r in rows.collect()}
    assert got == want and len(got) == 400
    assert {r["key"]: r["a"] for r in rows.collect()} == {r["key"]: r["a"] for r in table.collect()}
