"""Clustering queries, and SQL that repeats their steps: the same seeds, sums and roundings."""

import pyarrow as pa
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.operators import cluster as C
from leadloom.operators import kmeans as K
from leadloom.operators import reports as R
from leadloom.plans import contacts as PC
from leadloom.plans import duck as O
from leadloom.plans import reports as RP
from leadloom.plans.registry import cte, query
from leadloom.session import staged

c = F.col
STARTS, ITERATIONS, BATCHES, EPOCHS, KS = 3, 20, 4, 2, (3, 4, 5, 6)
XS = [f"x{i}" for i in range(6)]


# --- SQL -------------------------------------------------------------------
def points_sql(features: str, key: str, cols: list[str]) -> str:
    """Scaled features in ten-thousandths, and the batch of each row."""
    scaled = ", ".join(f"CAST(CASE WHEN s_{x} > 0 THEN round((CAST({x} AS DOUBLE) - m_{x}) / s_{x} * {K.UNIT}) ELSE 0 END AS BIGINT) AS x{i}" for i, x in enumerate(cols))
    return (f"SELECT CAST({key} AS VARCHAR) AS key, {scaled}, CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 6) AS BIGINT) % {BATCHES} AS batch "
            f"FROM {features}, (SELECT " + ", ".join(f"avg({x}) AS m_{x}, stddev_samp({x}) AS s_{x}" for x in cols) + f" FROM {features}) t")


def gap(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.{x} - {b}.{x}) * ({a}.{x} - {b}.{x})" for x in XS) + ")"


def rounded(total: str, n: str) -> str:
    return f"(sign({total}) * ((2 * abs({total}) + {n}) // (2 * {n})))"


def seeds_sql(name: str, source: str, k: int, start: int) -> list[tuple[str, str]]:
    """Steps <name>_<i> (key, x.., c): the first i + 1 seeds."""
    point = ", ".join(XS)
    out = [(f"{name}_0", f"SELECT {point}, 0 AS c FROM {source} ORDER BY md5('{start}:' || key), key LIMIT 1")]
    for i in range(1, k):
        far = f"SELECT p.key, {', '.join('p.' + x for x in XS)}, min({gap('p', 's')}) AS d FROM {source} p, {name}_{i - 1} s GROUP BY ALL"
        out.append((f"{name}_{i}", f"SELECT * FROM {name}_{i - 1} UNION ALL (SELECT {point}, {i} AS c FROM ({far}) f ORDER BY d DESC, key LIMIT 1)"))
    return out


def near_sql(points: str, centres: str) -> str:
    """(key, x.., k, s, c, d): the nearest centre of every point in every fit, the least number of equals."""
    return (f"SELECT key, {', '.join(f'any_value(p_{x}) AS {x}' for x in XS)}, k, s, arg_min(c, d * 16 + c) AS c, min(d) AS d FROM (SELECT p.key, "
            f"{', '.join(f'p.{x} AS p_{x}' for x in XS)}, m.k, m.s, m.c, {gap('p', 'm')} AS d FROM {points} p, {centres} m) t GROUP BY key, k, s")


def lloyd_sql(points: str, ks: tuple[int, ...]) -> list[tuple[str, str]]:
    """Steps up to lloyd(k, s, c, x..), the centres, and best(k, s), the start of least cost."""
    point = ", ".join(XS)
    out = [step for s in range(STARTS) for step in seeds_sql(f"seed{s}", points, max(ks), s)]
    first = " UNION ALL ".join(f"SELECT {k} AS k, {s} AS s, c, {point} FROM seed{s}_{k - 1}" for k in ks for s in range(STARTS))
    out.append(("move0", first))
    for i in range(1, ITERATIONS + 1):
        out.append((f"sum{i}", f"SELECT k, s, c, count(*) AS n, {', '.join(f'sum({x}) AS {x}' for x in XS)} FROM ({near_sql(points, f'move{i - 1}')}) t GROUP BY k, s, c"))
        means = ", ".join(f"CAST(coalesce({rounded('b.' + x, 'b.n')}, a.{x}) AS BIGINT) AS {x}" for x in XS)
        out.append((f"move{i}", f"SELECT a.k, a.s, a.c, {means} FROM move{i - 1} a LEFT JOIN sum{i} b ON a.k = b.k AND a.s = b.s AND a.c = b.c"))
    out.append(("lloyd", f"SELECT * FROM move{ITERATIONS}"))
    out.append(("best", f"SELECT k, arg_min(s, cost * 16 + s) AS s FROM (SELECT k, s, sum(d) AS cost FROM ({near_sql(points, 'lloyd')}) t GROUP BY k, s) u GROUP BY k"))
    out.append(("centres", "SELECT l.* FROM lloyd l JOIN best b ON l.k = b.k AND l.s = b.s"))
    return out


def mini_batch_sql(points: str, ks: tuple[int, ...]) -> list[tuple[str, str]]:
    """Steps up to centres(k, s, c, x..)."""
    point = ", ".join(XS)
    out = [("least", f"SELECT min(batch) AS b FROM {points}"), ("start", f"SELECT p.* FROM {points} p, least WHERE batch = b")]
    out += seeds_sql("seed", "start", max(ks), 0)
    out.append(("mini0", " UNION ALL ".join(f"SELECT {k} AS k, 0 AS s, c, {point}, 0 AS seen FROM seed_{k - 1}" for k in ks)))
    for i in range(EPOCHS * BATCHES):
        seen = "0" if i % BATCHES == 0 else "a.seen"
        part = f"(SELECT * FROM {points} WHERE batch = {i % BATCHES})"
        out.append((f"sum{i}", f"SELECT k, s, c, count(*) AS n, {', '.join(f'sum({x}) AS {x}' for x in XS)} FROM ({near_sql(part, f'mini{i}')}) t GROUP BY k, s, c"))
        means = ", ".join(f"CAST(CASE WHEN b.n IS NULL THEN a.{x} ELSE {rounded(f'(a.{x} * {seen} + b.{x})', f'({seen} + b.n)')} END AS BIGINT) AS {x}" for x in XS)
        out.append((f"mini{i + 1}", f"SELECT a.k, a.s, a.c, {means}, {seen} + coalesce(b.n, 0) AS seen FROM mini{i} a LEFT JOIN sum{i} b ON a.k = b.k AND a.c = b.c"))
    out.append(("centres", f"SELECT k, s, c, {point} FROM mini{EPOCHS * BATCHES}"))
    return out


def silhouette_sql(points: str) -> list[tuple[str, str]]:
    """Steps up to score(k, key, c, silhouette) of every row."""
    norm = " + ".join(f"CAST({x} AS HUGEINT) * {x}" for x in XS)
    dot = " + ".join(f"CAST(a.{x} AS DOUBLE) * CAST(b.{x} AS DOUBLE)" for x in XS)
    return [
        ("own", f"SELECT *, {norm} AS norm FROM ({near_sql(points, 'centres')}) t"),
        ("part", f"SELECT k, c, count(*) AS n, {', '.join(f'sum({x}) AS {x}' for x in XS)}, sum(norm) AS norm FROM own GROUP BY k, c"),
        ("away", f"SELECT a.k, a.key, a.c, b.c AS o, b.n, CAST(a.norm AS DOUBLE) * CAST(b.n AS DOUBLE) - ({dot}) * 2e0 + CAST(b.norm AS DOUBLE) AS total FROM own a JOIN part b ON a.k = b.k"),
        ("pair", "SELECT k, key, c, max(CASE WHEN o = c THEN n END) AS n, max(CASE WHEN o = c AND n > 1 THEN total / (n - 1e0) END) AS a, "
                 "min(CASE WHEN o <> c THEN total / CAST(n AS DOUBLE) END) AS b FROM away GROUP BY k, key, c"),
        ("score", "SELECT k, key, c, CASE WHEN b IS NULL THEN -1e0 WHEN n = 1 THEN 0e0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0e0 END AS silhouette FROM pair"),
        ("scores", "SELECT k, round(CAST(sum(CAST(silhouette AS DECIMAL(20,12))) AS DOUBLE) / count(*), 9) AS silhouette FROM score GROUP BY k")]


def steps(parts: list[tuple[str, str]], then: str) -> str:
    return "SELECT * FROM (WITH " + ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in parts) + f"\n{then}) result"


cte("o_points", points_sql("{o_features}", "profile_key", C.FEATURES))
cte("o_features_v3", """
SELECT lead_key, unified_score, CAST(source_weight AS DOUBLE) AS tier_weight, CAST(source_count AS DOUBLE) AS source_count, source_weight,
       CAST(coalesce(k.code, (SELECT code FROM {o_prov_codes} WHERE cat = 'Other')) AS DOUBLE) AS province_code, CAST(uid <> '' AS DOUBLE) AS has_uid
FROM {o_scored} s LEFT JOIN {o_prov_codes} k ON s.province = k.cat""")
cte("o_points_v3", points_sql("{o_features_v3}", "lead_key", C.FEATURES_V3))
LLOYD = lloyd_sql("{o_points}", (3,))
THREE = [*LLOYD, ("own", near_sql("{o_points}", "centres"))]
MINI = [*mini_batch_sql("{o_points_v3}", KS), *silhouette_sql("{o_points_v3}"),
        ("chosen", "SELECT k FROM scores ORDER BY silhouette DESC, k LIMIT 1"), ("mine", "SELECT own.* FROM own JOIN chosen USING (k)")]
_RANKED = ("ranked", "SELECT c, row_number() OVER (ORDER BY mean, c) - 1 AS cluster FROM (SELECT c, " + O.eavg("unified_score", 6)
           + " AS mean FROM own JOIN {o_features} f ON CAST(f.profile_key AS VARCHAR) = own.key GROUP BY c) t")
_LABEL = "CASE cluster " + " ".join(f"WHEN {n} THEN {O.lit(t)}" for n, t in D.CLUSTER_LABELS.items()) + f" ELSE {O.lit(D.UNCLUSTERED_LABEL)} END"
_P = D.PERSONAS
_PERSONAS = ("named", f"""SELECT c, CASE WHEN u > 65 THEN {O.lit(_P['hnw'])} WHEN u > 45 AND t >= 0.8e0 THEN {O.lit(_P['business'])} WHEN u > 40 AND n >= 2 THEN {O.lit(_P['cross'])}
 WHEN t >= 0.8e0 THEN {O.lit(_P['finance'])} WHEN n > 1.5e0 THEN {O.lit(_P['multichannel'])} ELSE {O.lit(_P['mass'])} END AS persona
FROM (SELECT c, {O.eavg('unified_score', 6)} AS u, {O.eavg('tier_weight', 6)} AS t, {O.eavg('source_count', 6)} AS n
      FROM mine JOIN {{o_features_v3}} f ON CAST(f.lead_key AS VARCHAR) = mine.key GROUP BY c) x""")


# --- three clusters of profiles ---------------------------------------------
def _points(spark, sf):
    features = staged(RP.features(spark, sf), "features")
    return K.feature_points(features, C.FEATURES, "profile_key", keep=["unified_score"])  # full passes


def _three(spark, sf):
    rows = _points(spark, sf)
    return rows, K.fit(rows, 3, STARTS, ITERATIONS)


def small_frame(spark, kinds, rows):
    """A few rows of the driver, as Arrow columns: no Python task makes them."""
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())}))


def centres_frame(spark, rows, centres):
    """One row per centre: its number, rows, squared distances and coordinates."""
    found = K.sums(rows, {(len(centres), 0): centres})
    out = [(n, *found.get((len(centres), 0, n), (0, None, 0))[::2], *centre) for n, centre in enumerate(centres)]
    return small_frame(spark, {"cluster_raw": pa.int64(), "n": pa.int64(), "cost": pa.string()} | dict.fromkeys(XS, pa.int64()),
                       [(a, b, str(d), *xs) for a, b, d, *xs in out])


_CENTRES = """SELECT CAST(m.c AS BIGINT) AS cluster_raw, count(t.key) AS n, CAST(coalesce(sum(t.d), 0) AS VARCHAR) AS cost, """ + ", ".join(f"m.{x}" for x in XS)


@query("ml3_kmeans_3", steps(THREE, f"{_CENTRES} FROM centres m LEFT JOIN own t ON m.c = t.c GROUP BY ALL"))
def ml3_kmeans_3(spark, sf):
    """Centres, sizes and costs of three clusters."""
    rows, centres = _three(spark, sf)
    return centres_frame(spark, rows, centres)


@query("ml3_clusters", steps(THREE, "SELECT key AS profile_key, CAST(c AS INTEGER) AS cluster_raw FROM own"))
def ml3_clusters(spark, sf):
    rows, centres = _three(spark, sf)
    return K.labelled(rows, centres).select(c("key").alias("profile_key"), "cluster_raw")


_SILHOUETTE = [*LLOYD, *silhouette_sql("{o_points}")]


@query("ml4_silhouette", steps(_SILHOUETTE, "SELECT CAST(c AS BIGINT) AS cluster_raw, count(*) AS n, " + O.rnd("sum(CAST(silhouette AS DECIMAL(20,12))) / count(*)", 6)
                               + " AS silhouette FROM score GROUP BY c"))
def ml4_silhouette(spark, sf):
    """Mean silhouette of each cluster."""
    rows, centres = _three(spark, sf)
    out = K.silhouette_rows(rows, {3: centres}).groupBy(c("c3").cast("long").alias("cluster_raw")).agg(
        F.count("*").alias("n"), F.sum(c("s3").cast("decimal(20,12)")).alias("total"))
    return out.select("cluster_raw", "n", F.round((c("total").cast("double") / c("n")).cast("decimal(38,10)"), 6).cast("double").alias("silhouette"))


@query("ml4_silhouette_value", steps(_SILHOUETTE, "SELECT CAST(k AS INTEGER) AS k, silhouette FROM scores"))
def ml4_silhouette_value(spark, sf):
    rows, centres = _three(spark, sf)
    return small_frame(spark, {"k": pa.int32(), "silhouette": pa.float64()}, list(K.silhouettes(rows, {3: centres}).items()))


def _ranked(spark, sf):
    rows, centres = _three(spark, sf)
    both = K.labelled(rows, centres).withColumnRenamed("key", "profile_key")
    means = both.groupBy("cluster_raw").agg(K.exact_avg(c("unified_score"), 6).alias("mean"))
    ranks = means.select("cluster_raw", (F.row_number().over(C.Window.partitionBy(F.lit(1)).orderBy("mean", "cluster_raw")) - 1).alias("cluster"))  # k rows
    return both.join(F.broadcast(ranks), "cluster_raw").withColumn("cluster_label", C.cluster_label(c("cluster")))


@query("ml5_rank_clusters", steps([*THREE, _RANKED], "SELECT CAST(cluster AS INTEGER) AS cluster, " + _LABEL + " AS cluster_label, count(*) AS profiles, " + O.eavg("unified_score", 6)
                                  + " AS mean_score FROM own JOIN ranked USING (c) JOIN {o_features} f ON CAST(f.profile_key AS VARCHAR) = own.key GROUP BY 1, 2"))
def ml5_rank_clusters(spark, sf):
    return _ranked(spark, sf).groupBy("cluster", "cluster_label").agg(F.count("*").alias("profiles"), K.exact_avg(c("unified_score"), 6).alias("mean_score"))


@query("ml5_ranked_profiles", steps([*THREE, _RANKED], "SELECT f.profile_key, CAST(cluster AS INTEGER) AS cluster, " + _LABEL
                                    + " AS cluster_label, unified_score FROM own JOIN ranked USING (c) JOIN {o_features} f ON CAST(f.profile_key AS VARCHAR) = own.key"))
def ml5_ranked_profiles(spark, sf):
    return _ranked(spark, sf).select("profile_key", "cluster", "cluster_label", "unified_score")


# --- personas of contacts -----------------------------------------------------
def _points_v3(spark, sf):
    scored = PC.scored(spark, sf).select("lead_key", "unified_score", "source_tier", "source_count", "source_weight", "province", "uid")
    features = C.features_v3(staged(scored, "scored"), "province")  # a few lookups a row, read twice
    return K.feature_points(features, C.FEATURES_V3, "lead_key", BATCHES, ["unified_score", "tier_weight", "source_count"])


@query("ml7_choose_k", steps(MINI, "SELECT CAST(s.k AS INTEGER) AS k, silhouette, chosen.k IS NOT NULL AS chosen FROM scores s LEFT JOIN chosen ON s.k = chosen.k"))
def ml7_choose_k(spark, sf):
    _, scores = K.fit_best(_points_v3(spark, sf), KS, BATCHES, EPOCHS)
    return small_frame(spark, {"k": pa.int32(), "silhouette": pa.float64(), "chosen": pa.bool_()},
                       [(k, v, k == K.best_k(scores)) for k, v in scores.items()])


@query("ml7_silhouettes", steps(MINI, "SELECT CAST(k AS INTEGER) AS k, silhouette FROM scores"))
def ml7_silhouettes(spark, sf):
    return ml7_choose_k(spark, sf).select("k", "silhouette")


@query("ml8_final_fit", steps(MINI, f"{_CENTRES} FROM centres m JOIN chosen USING (k) LEFT JOIN mine t ON m.c = t.c GROUP BY ALL"))
def ml8_final_fit(spark, sf):
    """Mini-batch centres for the chosen k, with their rows and costs over all contacts."""
    rows = _points_v3(spark, sf)
    return centres_frame(spark, rows, K.fit_best(rows, KS, BATCHES, EPOCHS)[0])


def _best(spark, sf):
    rows = _points_v3(spark, sf)
    return K.labelled(rows, K.fit_best(rows, KS, BATCHES, EPOCHS)[0]).withColumnRenamed("key", "lead_key")


@query("ml8_clusters", steps(MINI, "SELECT f.lead_key, CAST(c AS INTEGER) AS cluster_raw FROM mine JOIN {o_features_v3} f ON CAST(f.lead_key AS VARCHAR) = mine.key"))
def ml8_clusters(spark, sf):
    return _best(spark, sf).select("lead_key", "cluster_raw")


@query("ml9_persona_label", steps([*MINI, _PERSONAS], "SELECT f.lead_key, persona FROM mine JOIN named USING (c) JOIN {o_features_v3} f ON CAST(f.lead_key AS VARCHAR) = mine.key"))
def ml9_persona_label(spark, sf):
    return K.with_persona(_best(spark, sf)).select("lead_key", "persona")


@query("ml9_persona_counts", steps([*MINI, _PERSONAS], f"SELECT persona, n AS contacts, {O.rnd('n * 100e0 / sum(n) OVER ()', 1)} AS share_pct FROM (SELECT persona, count(*) AS n FROM mine JOIN named USING (c) GROUP BY 1) t"))
def ml9_persona_counts(spark, sf):
    return R.counts_with_share(K.with_persona(_best(spark, sf)), c("persona"), "persona")
