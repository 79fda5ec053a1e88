"""Numbering and partition counts shared by the training-data operators."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.session import staged


def power_of_two(spark: SparkSession, times: int = 1) -> int:
    """The least power of two that is not below ``times`` the shuffle partitions of the session."""
    return 1 << max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) * times - 1).bit_length()


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def hash60(*parts: Column) -> Column:
    """60 bits of an md5, so that other engines can compute the same number."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def place_in_buckets(df: DataFrame, by: list[str], bucket: str, order: list[Column], alias: str) -> DataFrame:
    """0-based place of a row within ``by`` under (bucket, order), without one task per group.

    ``bucket`` rises with the order, so that a row's place is its place in the
    bucket plus the rows of the buckets before it.  Only the table of bucket
    sizes is windowed over a whole group.  ``by`` and ``bucket`` hold no nulls.
    Adds ``alias`` and ``alias_total``, the rows of the group.
    """
    sizes = df.groupBy(*by, bucket).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(whole).alias(f"{alias}_total"))
    inside = Window.partitionBy(*by, bucket).orderBy(*order)
    rows = df.withColumn("_place", F.row_number().over(inside) - 1)
    return rows.join(offsets, [*by, bucket]).withColumn(alias, F.col("_place") + F.col("_before")).drop("_place", "_before")


__all__ = ["hash60", "place_in_buckets", "power_of_two", "staged", "text_or_empty"]
