"""K-means whose result does not depend on partitioning, run order or engine.

Points are whole numbers (scaled features in ten-thousandths), distances are
exact, sums are exact decimals, and every tie is broken by a number or a key.  A
step is one stage over the points without a shuffle: a task reduces its Arrow
batches to k rows per fit, and the driver adds these up, rounds the new centres and
ships them with the next step.  No step has code of its own to compile, and several
fits (values of k, starts) share their passes.
"""

from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from leadloom.functions.numbers import exact_avg
from leadloom.operators.cluster import impute_scale, persona
from leadloom.session import new_dir, ship

UNIT = 10_000

Centre = tuple[int, ...]
Fits = dict[tuple[int, int], list[Centre]]  # centres by (k, start)


def batch_of(key: Column, batches: int) -> Column:
    """Seeded batch of a row: a number any engine can compute from the key."""
    if batches == 1:
        return F.lit(0)
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long") % batches).cast("int")


def points(scaled: DataFrame, key: str, batches: int = 1) -> DataFrame:
    """(key, x0.., batch) of the vectors in ``scaled``, written in folders by batch so that a batch reads its rows only."""
    size = scaled.select(F.size(vector_to_array("scaled"))).first()
    values = vector_to_array("scaled")
    return _written(scaled, key, [values[i] for i in range(size[0] if size else 0)], batches, ())


def feature_points(features: DataFrame, cols: list[str], key: str, batches: int = 1, keep: Iterable[str] = ()) -> DataFrame:
    """The points of feature columns, scaled by the means and deviations that one pass finds, and the columns ``keep`` beside them.

    Only features with missing values go the longer way over their medians.
    """
    stats = [f(F.col(x)).alias(f"{name}{i}") for i, x in enumerate(cols) for name, f in (("m", F.avg), ("s", F.stddev_samp))]
    r = features.agg(*stats, *[F.count_if(F.col(x).isNull() | F.isnan(x)).alias(f"gaps{i}") for i, x in enumerate(cols)]).first()
    if any(r[f"gaps{i}"] for i in range(len(cols))):
        values = vector_to_array("scaled")
        kept = features.select(key, *[F.col(x).alias(f"_{x}") for x in keep], *cols)
        return _written(impute_scale(kept, cols), key, [values[i] for i in range(len(cols))], batches, [F.col(f"_{x}").alias(x) for x in keep])
    scaled = [(F.col(x) - r[f"m{i}"]) / r[f"s{i}"] if r[f"s{i}"] else F.lit(0.0) for i, x in enumerate(cols)]
    return _written(features, key, scaled, batches, keep)


def _written(rows: DataFrame, key: str, values: list[Column], batches: int, keep: Iterable) -> DataFrame:
    rows = rows.select(F.col(key).cast("string").alias("key"), *[F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(values)],
                       *keep, batch_of(F.col(key), batches).alias("batch"))
    path = new_dir(rows.sparkSession, "points")
    rows.write.partitionBy("batch").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def coordinates(rows: DataFrame) -> list[str]:
    return sorted((c for c in rows.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def nearest(xs: list[str], centres: list[Centre]) -> Column:
    """The least (d, c): squared distance to a centre and the centre's number."""
    def distance(centre: Centre) -> Column:
        gaps = [F.col(x) - F.lit(v).cast("long") for x, v in zip(xs, centre, strict=True)]
        return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])

    options = [F.struct(distance(centre).alias("d"), F.lit(c).alias("c")) for c, centre in enumerate(centres)]
    return F.least(*options) if len(options) > 1 else options[0]


def _matrix(batch: pa.RecordBatch, xs: list[str]) -> np.ndarray:
    return np.stack([batch.column(x).to_numpy() for x in xs], 1)


def _gaps(x: np.ndarray, centres: list[Centre]) -> np.ndarray:
    """Squared distances, a row per centre."""
    return np.stack([((x - np.array(m, np.int64)) ** 2).sum(1) for m in centres])


def farthest(rows: DataFrame, found: dict[int, list[Centre]]) -> dict[int, Centre]:
    """Per start the row farthest from the seeds it has, ties by key, in one pass for all starts."""
    xs = coordinates(rows)

    def run(batches):
        best: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, keys = _matrix(batch, xs), batch.column("key")
            for s, seen in found.items():
                d = _gaps(x, seen).min(0)
                at = np.flatnonzero(d == d.max())
                key, i = min(zip(keys.take(pa.array(at)).to_pylist(), at.tolist(), strict=True), key=lambda o: (o[0] is not None, o[0]))
                mine = (-int(d[i]), (key is not None, key), x[i].tolist())
                best[s] = min(best[s], mine) if s in best else mine
        if best:
            yield pa.RecordBatch.from_pydict(
                {"s": pa.array(list(best), pa.int32()), "d": pa.array([b[0] for b in best.values()], pa.int64()),
                 "key": pa.array([b[1][1] for b in best.values()], pa.string()), **{x: pa.array([b[2][i] for b in best.values()], pa.int64()) for i, x in enumerate(xs)}})

    kind = "s int, d long, key string, " + ", ".join(f"{x} long" for x in xs)
    far: dict = {}
    for r in ship(rows).select("key", *xs).mapInArrow(run, kind).collect():  # a row per start and task
        mine = (r["d"], (r["key"] is not None, r["key"]), tuple(r[x] for x in xs))
        far[r["s"]] = min(far.get(r["s"], mine), mine)
    return {s: mine[2] for s, mine in far.items()}


def seeds_of(rows: DataFrame, k: int, starts: Iterable[int]) -> dict[int, list[Centre]]:
    """The farthest-first seeds of several starts in k passes; none for points of an empty table."""
    xs, starts = coordinates(rows), list(starts)
    if not xs:
        return {s: [] for s in starts}
    point = F.struct(*xs)
    first = rows.agg(*[F.min_by(point, F.struct(F.md5(F.concat(F.lit(f"{s}:"), "key")), F.col("key"))).alias(f"s{s}") for s in starts]).first()
    if first[f"s{starts[0]}"] is None:
        return {s: [] for s in starts}
    found = {s: [tuple(first[f"s{s}"])] for s in starts}
    for _ in range(k - 1):
        for s, p in farthest(rows, found).items():
            found[s] = [*found[s], p]
    return found


def seeds(rows: DataFrame, k: int, start: int = 0) -> list[Centre]:
    """Farthest-first: a row that a hash of start and key picks, then k - 1 times the row farthest from all before, ties by key.

    The first seeds of a larger k are those of a smaller one.
    """
    return seeds_of(rows, k, [start])[start]


def rounded(total: int, n: int) -> int:
    """total / n as the nearest whole number, halves away from zero."""
    value = (2 * abs(total) + n) // (2 * n)
    return value if total >= 0 else -value


def _totals(rows: DataFrame, fits: Fits, norms: bool) -> dict[tuple[int, int, int], list[int]]:
    """{(k, start, c): [n, x0.., t]}: rows, coordinate sums and sum of squared distances (or norms) of every cluster of every fit, in one pass."""
    xs = coordinates(rows)

    def run(batches):
        kept: dict = {}  # exact: whole numbers of any size per task
        for batch in batches:
            x = _matrix(batch, xs)
            squares = (x * x).sum(1) if norms else None
            for (k, s), centres in fits.items():
                d = _gaps(x, centres)
                c = d.argmin(0)
                measure = squares if norms else d.min(0)
                for n in range(len(centres)):
                    own = c == n
                    if own.any():
                        high, low = measure[own] >> 32, measure[own] & 0xFFFFFFFF  # so that no sum of a batch overflows
                        new = [int(own.sum()), *x[own].sum(0).tolist(), (int(high.sum()) << 32) + int(low.sum())]
                        kept[k, s, n] = [a + b for a, b in zip(kept[k, s, n], new, strict=True)] if (k, s, n) in kept else new
        if kept:
            names = ["n", *xs, "t"]
            yield pa.RecordBatch.from_pydict(
                {**{name: pa.array([f[i] for f in kept], pa.int32()) for i, name in enumerate("ksc")},
                 **{name: pa.array([Decimal(v[i]) for v in kept.values()], pa.decimal128(38, 0)) for i, name in enumerate(names)}})

    kind = "k int, s int, c int, " + ", ".join(f"{x} decimal(38,0)" for x in ("n", *xs, "t"))
    found: dict = {}
    for r in ship(rows).select(*xs).mapInArrow(run, kind).collect():  # k rows a fit and task
        key, new = (r["k"], r["s"], r["c"]), [int(r[x]) for x in ("n", *xs, "t")]
        found[key] = [a + b for a, b in zip(found[key], new, strict=True)] if key in found else new
    return found


def sums(rows: DataFrame, fits: Fits) -> dict[tuple[int, int, int], tuple[int, list[int], int]]:
    """Rows, coordinate sums and squared distances of every cluster of every fit, in one pass: {(k, start, c): (n, sums, cost)}."""
    return {key: (n, totals, cost) for key, (n, *totals, cost) in _totals(rows, fits, False).items()} if fits and coordinates(rows) else {}


def lloyd(rows: DataFrame, ks: Iterable[int] = (3,), starts: int = 3, iterations: int = 20) -> tuple[Fits, dict[tuple[int, int], int]]:
    """Centres and costs of all fits of ``ks`` clusters from ``starts`` farthest-first starts; a cluster without rows keeps its centre."""
    first = seeds_of(rows, max(ks), range(starts))
    fits = {(k, s): first[s][:k] for k in ks for s in range(starts) if first[s]}
    moving = dict(fits)
    for _ in range(iterations):
        if not moving:
            break
        found, still = sums(rows, moving), {}
        for (k, s), centres in moving.items():
            new = [tuple(rounded(t, found[k, s, c][0]) for t in found[k, s, c][1]) if (k, s, c) in found else old for c, old in enumerate(centres)]
            if new != centres:
                fits[k, s] = still[k, s] = new
        moving = still
    costs = dict.fromkeys(fits, 0)
    for (k, s, _), (_, _, cost) in (sums(rows, fits) if fits else {}).items():
        costs[k, s] += cost
    return fits, costs


def best_start(fits: Fits, costs: dict[tuple[int, int], int], k: int) -> list[Centre]:
    """Centres of the start with the least cost, the first of equals."""
    return fits[min(((k, s) for kk, s in fits if kk == k), key=lambda f: (costs[f], f[1]))]


def fit(rows: DataFrame, k: int = 3, starts: int = 3, iterations: int = 20) -> list[Centre]:
    """Centres of the best of several starts (none without rows)."""
    fits, costs = lloyd(rows, (k,), starts, iterations)
    return best_start(fits, costs, k) if fits else []


def mini_batch(rows: DataFrame, ks: Iterable[int] = (3, 4, 5, 6), batches: int = 8, epochs: int = 3) -> dict[int, list[Centre]]:
    """Mini-batch k-means: centres per k after ``epochs`` passes over ``batches`` batches of the points.

    Seeds are farthest-first in the first batch that has rows.  A batch is one
    aggregation over its rows for all k; each centre moves to the mean of what it
    was given since the epoch began, so its learning rate is the batch's share
    of those rows.  The points are read epochs + max(ks) / batches times in all.
    """
    part = {b: rows.filter(F.col("batch") == b) for b in range(batches)}
    first = next((found for b in range(batches) if (found := seeds(part[b], max(ks)))), [])
    fits: Fits = {(k, 0): first[:k] for k in ks} if first else {}
    for _ in range(epochs if fits else 0):
        given = {(k, c): 0 for k in ks for c in range(k)}
        for b in range(batches):
            for (k, _, c), (n, totals, _) in sums(part[b], fits).items():
                seen, centre = given[k, c], fits[k, 0][c]
                moved = tuple(rounded(old * seen + new, seen + n) for old, new in zip(centre, totals, strict=True))
                fits[k, 0] = [*fits[k, 0][:c], moved, *fits[k, 0][c + 1:]]
                given[k, c] = seen + n
    return {k: centres for (k, _), centres in fits.items()}


def labelled(rows: DataFrame, centres: list[Centre]) -> DataFrame:
    """The points with ``cluster_raw``, the number of the nearest centre (least of equals), and ``distance``, the square of its distance."""
    near = nearest(coordinates(rows), centres)
    return rows.withColumns({"cluster_raw": near["c"], "distance": near["d"]})


def moments(rows: DataFrame, fits: Fits) -> dict[tuple[int, int], dict[int, tuple[float, list[float], float]]]:
    """Rows, coordinate sums and sum of squared norms of every cluster of every fit, in one pass."""
    out = {f: {} for f in fits}
    for (k, s, c), (n, *totals, squares) in sorted(_totals(rows, fits, True).items()):
        out[k, s][c] = (float(n), [float(x) for x in totals], float(squares))
    return out


def _silhouette(x: np.ndarray, centres: list[Centre], clusters: dict[int, tuple[float, list[float], float]]) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and silhouette of rows by squared distances: the mean distance to a cluster follows from its rows, sums and squared norms.

    0 in a cluster of one row, -1 where all rows are in one cluster.
    """
    own, norm, values = _gaps(x, centres).argmin(0), (x * x).sum(1).astype(float), x.astype(float)
    if len(clusters) < 2:
        return own, np.full(len(x), -1.0)
    away, out = {}, np.zeros(len(x))
    for c, (n, totals, squares) in clusters.items():
        dot = values[:, 0] * totals[0]
        for i in range(1, values.shape[1]):
            dot = dot + values[:, i] * totals[i]
        away[c] = norm * n - dot * 2.0 + squares
    for c, (n, _, _) in clusters.items():
        mine = own == c
        if n > 1:
            inside = away[c][mine] / (n - 1.0)
            outside = np.min([away[o][mine] / clusters[o][0] for o in clusters if o != c], axis=0)
            widest = np.maximum(inside, outside)
            out[mine] = np.where(widest > 0, (outside - inside) / np.where(widest > 0, widest, 1.0), 0.0)
    return own, out


def silhouette_rows(rows: DataFrame, fits: dict[int, list[Centre]]) -> DataFrame:
    """(c<k>, s<k>) of every row: its cluster and silhouette in the fit of each k, in two passes for all of them."""
    parts, xs = moments(rows, {(k, 0): centres for k, centres in fits.items()}), coordinates(rows)

    def run(batches):
        for batch in batches:
            x, out = _matrix(batch, xs), {}
            for k, centres in fits.items():
                c, value = _silhouette(x, centres, parts[k, 0])
                out |= {f"c{k}": pa.array(c, pa.int32()), f"s{k}": pa.array(value)}
            yield pa.RecordBatch.from_pydict(out)

    return ship(rows).select(*xs).mapInArrow(run, ", ".join(f"c{k} int, s{k} double" for k in fits))


def silhouettes(rows: DataFrame, fits: dict[int, list[Centre]]) -> dict[int, float]:
    """Mean silhouette of all rows per k, in two passes for all of them."""
    if not fits:
        return {}
    exact = [F.sum(F.col(f"s{k}").cast("decimal(20,12)")).alias(f"k{k}") for k in fits]
    r = silhouette_rows(rows, fits).agg(F.count("*").alias("n"), *exact).first()
    return {k: round(float(r[f"k{k}"]) / r["n"], 9) for k in fits}


def best_k(scores: dict[int, float]) -> int:
    """The k with the best silhouette, the smallest of equals."""
    return min(scores, key=lambda k: (-scores[k], k))


def fit_best(rows: DataFrame, ks: Iterable[int] = (3, 4, 5, 6), batches: int = 8, epochs: int = 3) -> tuple[list[Centre], dict[int, float]]:
    """Mini-batch centres for the k with the best silhouette over all rows, and the silhouettes; the k share all passes."""
    fits = mini_batch(rows, ks, batches, epochs)
    scores = silhouettes(rows, fits)
    return (fits[best_k(scores)] if fits else []), scores


def with_cluster(table: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """The rows of ``table`` with the ``cluster_raw`` of their key."""
    found = labels.select(F.col("key").alias("_key"), "cluster_raw")
    return table.join(found, F.col(key).cast("string") == F.col("_key")).drop("_key")


def with_persona(table: DataFrame) -> DataFrame:
    """Persona of each ``cluster_raw`` from the exact means of its rows (its centre in the features' own units)."""
    centres = table.groupBy("cluster_raw").agg(*[exact_avg(F.col(c), 6).alias(f"_{c}") for c in ("unified_score", "tier_weight", "source_count")])
    names = centres.select("cluster_raw", persona(F.col("_unified_score"), F.col("_tier_weight"), F.col("_source_count")).alias("persona"))
    return table.join(F.broadcast(names), "cluster_raw")  # k rows
