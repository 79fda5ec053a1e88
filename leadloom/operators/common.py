"""Building blocks that keep plans cheap and skew-proof."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.session import staged


def computed_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns that later filters and join keys will not re-evaluate.

    A plain projection lets filter push-down copy its expressions into every
    filter below it; the one-element ``inline`` stops that without a shuffle.
    """
    keep = [c for c in df.columns if c not in cols]
    row = F.array(F.struct(*[expr.alias(name) for name, expr in cols.items()]))
    return df.select(*keep, F.inline(row))


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Repartition an input that has fewer splits than the cluster has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key or df.columns[0])


def join_dimension(big: DataFrame, small: DataFrame, on: str, row: list[str], how: str = "left") -> DataFrame:
    """Join with a table of one row per key; nothing runs while the plan is built.

    How to join is left to adaptive execution: it sees the real sizes,
    broadcasts a small side and splits skewed keys.  Rows without a key match
    nothing; ``row``, columns that identify a row, gives each a key of its own,
    so that they do not meet in one task.
    """
    if how == "inner":
        return big.join(small, on, how)
    apart = F.concat(F.lit("\0"), F.xxhash64(*row).cast("string"))
    keyed = big.withColumn("_key", F.coalesce(F.col(on).cast("string"), apart))
    side = small.filter(F.col(on).isNotNull()).withColumn("_key", F.col(on).cast("string")).drop(on)
    return keyed.join(side, "_key", how).drop("_key")


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row frames side by side, without a cross join."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


STEPS, COARSE = 512, 24  # cuts of a large key, and how many of them one comparison passes over


def blocked(df: DataFrame, key: str, order: str, block: int) -> DataFrame:
    """Adds ``_block``: consecutive rows of a key in blocks, numbered in order.

    ``order`` is a whole number and may be anything from a dense count to a time
    in microseconds with bursts.  A key of more than twice ``block`` rows is cut at
    its own quantiles, from counts that are merged on the map side, into blocks of
    about ``block`` rows or 1 / ``STEPS`` of its rows, whichever is more.  The cuts
    of those keys are written, so that every use sees the same blocks.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 2 * block)
    hot = df.select(key, order).join(sizes, key)
    every = F.greatest(F.lit(1), F.floor(F.lit(STEPS * block) / F.max("_n"))).cast("int")
    cuts = hot.groupBy(key).agg(F.percentile_approx(order, [i / STEPS for i in range(1, STEPS)], 10 * STEPS).alias("_q"), every.alias("_every"))
    kept = F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % F.col("_every") == 0))
    cuts = staged(cuts.select(key, kept.alias("_cuts")), "cuts")
    rows = df.join(cuts, key, "left")
    # cuts below the row: first by every COARSE-th, then among those that follow
    marks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.size("_cuts") / COARSE))).cast("array<int>"), lambda i: F.get("_cuts", i * COARSE - 1))
    passed = F.size(F.filter(marks, lambda x: x < F.col(order))) * COARSE
    rows = rows.withColumn("_passed", F.when(F.col("_cuts").isNotNull(), passed).otherwise(0))
    more = F.size(F.filter(F.slice("_cuts", F.col("_passed") + 1, F.lit(COARSE)), lambda x: x < F.col(order)))
    return rows.withColumn("_block", F.col("_passed") + F.coalesce(F.when(F.col("_cuts").isNotNull(), more), F.lit(0))).drop("_cuts", "_passed")


def blocked_lag(df: DataFrame, key: str, order: str, value: Column, alias: str,
                block: int = 10_000) -> DataFrame:
    """``lag`` of a struct per key without sorting a whole key in one task.

    ``order`` is a whole number, unique per key.  A block of rows (``blocked``)
    looks back inside itself, and its first row takes the last value of the
    nearest earlier block from a small table with one row per block.
    """
    rows = blocked(df, key, order, block).withColumn("_value", value)
    inside = Window.partitionBy(key, "_block").orderBy(order)
    rows = rows.withColumn("_prev", F.lag("_value").over(inside))
    tails = rows.groupBy(key, "_block").agg(F.max_by("_value", order).alias("_tail"))
    carried = tails.withColumn("_carry", F.lag("_tail").over(Window.partitionBy(key).orderBy("_block"))).drop("_tail")
    return (rows.join(carried, [key, "_block"], "left")
            .withColumn(alias, F.coalesce("_prev", "_carry"))
            .drop("_block", "_value", "_prev", "_carry"))


def blocked_row_number(df: DataFrame, key: str, order: str, alias: str, block: int = 10_000) -> DataFrame:
    """1-based row number per key, computed per block (``blocked``) plus the block's offset."""
    rows = blocked(df, key, order, block)
    counts = rows.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(key)).alias(f"{alias}_total"))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    return (rows.withColumn("_rn", F.row_number().over(inside))
            .join(offsets, [key, "_block"], "left")
            .withColumn(alias, F.col("_rn") + F.col("_offset"))
            .drop("_block", "_rn", "_offset"))


def top_per_key(df: DataFrame, key: str, order: list, n: int, salt: Column, salts: int = 32) -> DataFrame:
    """The first n rows per key: n per salted part of a key first, then n per key."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    first = Window.partitionBy(key, "_salt").orderBy(*order)
    final = Window.partitionBy(key).orderBy(*order)
    return (part.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= n)
            .withColumn("_r", F.row_number().over(final)).filter(F.col("_r") <= n)
            .withColumnRenamed("_r", "rank").drop("_salt"))


def numbered(df: DataFrame, order: list, alias: str) -> DataFrame:
    """Running number over a global order without a one-task window.

    The range-partitioned rows are written with their partition number, so that
    every pass sees the same parts; a row's number is its place in the part plus
    the size of the parts before it.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (ranged.withColumn("_rn", F.row_number().over(inside))
            .join(F.broadcast(offsets), "_part")  # one row per partition
            .withColumn(alias, F.col("_rn") + F.col("_offset")).drop("_part", "_rn", "_offset"))
