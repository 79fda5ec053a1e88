"""Blocks by rows, and exact quantiles in bounded state."""

import random

from pyspark.sql import functions as F

from leadloom.operators import common as C
from leadloom.operators import reports as R


def messages(spark):
    """One conversation of 60,000 messages with microsecond numbers, half of them in one crowded minute; small ones beside it."""
    hot = spark.range(60_000).select(F.lit("hot").alias("conv_id"), F.when(F.col("id") < 30_000, F.col("id") * 7_000_003).otherwise(
        30_000 * 7_000_003 + F.col("id") * 3).cast("long").alias("idx"))
    few = spark.range(50).select(F.concat(F.lit("c"), F.col("id") % 5).alias("conv_id"), (F.col("id") * 10**9).alias("idx"))
    return hot.unionByName(few).unionByName(spark.createDataFrame([("one", 5)], "conv_id string, idx long"))


def test_blocks_follow_the_rows(spark):
    rows = C.blocked(messages(spark), "conv_id", "idx", 1000)
    sizes = [r["count"] for r in rows.filter("conv_id = 'hot'").groupBy("_block").count().collect()]
    sizes.sort()
    assert sum(sizes) == 60_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2] and 30 <= len(sizes) <= 120
    assert rows.filter("conv_id <> 'hot'").select("conv_id", "_block").distinct().count() == 6
    ordered = rows.groupBy("conv_id", "_block").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    pairs = sorted((r["conv_id"], r["_block"], r["lo"], r["hi"]) for r in ordered.collect())
    assert all(a[0] != b[0] or a[3] < b[2] for a, b in zip(pairs, pairs[1:]))


def test_lag_and_number_equal_plain_windows(spark):
    df = messages(spark).cache()
    w = C.Window.partitionBy("conv_id").orderBy("idx")
    plain = df.select("conv_id", "idx", F.lag(F.struct("idx")).over(w).alias("prev"), F.row_number().over(w).cast("long").alias("n"))
    lagged = C.blocked_lag(df, "conv_id", "idx", F.struct("idx"), "prev", 1000)
    numbered = C.blocked_row_number(df, "conv_id", "idx", "n", 1000)
    both = lagged.join(numbered, ["conv_id", "idx"]).select("conv_id", "idx", "prev", "n")
    assert plain.exceptAll(both).isEmpty() and both.count() == df.count()
    assert {(r["conv_id"], r["n_total"]) for r in numbered.select("conv_id", "n_total").distinct().collect()} == {
        (r["conv_id"], r["count"]) for r in df.groupBy("conv_id").count().collect()}


def test_quantiles_equal_percentile(spark):
    r = random.Random(3)
    for values in ([5.0], [1.0, 2.0], [3.0] * 50, [r.gauss(0, 1) for _ in range(999)], [10.0 ** r.uniform(-300, 300) for _ in range(500)],
                   [-1e308, 1e308, 0.0, 5e-324, -5e-324], [0.1] * 300 + [0.1 + i * 1e-15 for i in range(300)]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
        want = df.agg(F.percentile("x", probabilities)).first()[0]
        n, low, high = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
        got = R.order_statistics(df, "x", list(range(0, n, max(1, n // 9))), low, high, bins=8, few=3)
        assert got == {i: sorted(values)[i] for i in range(0, n, max(1, n // 9))}
        assert all(abs(a - b) <= 1e-12 * abs(b) for a, b in zip(R.quantiles(df, "x", probabilities), want, strict=True))
    assert R.quantiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_ten_million_distinct_values(spark):
    n = 10_000_000
    df = spark.range(n).select((F.pmod(F.col("id") * 7_368_787, F.lit(n)) / 7.0).alias("x"))  # each of 0 .. n - 1 once
    assert R.quantiles(df, "x", [0.25, 0.5, 1.0]) == [2499999.75 / 7, 4999999.5 / 7, (n - 1) / 7] or [
        round(v * 7, 3) for v in R.quantiles(df, "x", [0.25, 0.5, 1.0])] == [2499999.75, 4999999.5, n - 1]
