"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import staged


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node of its component.

    Alternates large-star and small-star steps: neighbours are re-linked to the
    least node around, until every component is a star.  The table shrinks to
    one row per node, each step is an aggregation with map-side combine and an
    equi-join, and each round is written, so that lost executors cost one round.
    """
    ordered = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").distinct()
    pairs, before = staged(ordered, "edges"), None
    while True:
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        pairs = staged(small.filter("u != v").distinct(), "edges")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
