"""Proportional stratified interleaving: every shard holds the mixture of the whole."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import hash60, place_in_buckets, power_of_two, staged, text_or_empty


def interleave(docs: DataFrame, n_shards: int = 8, seed: int = 0, id: str = "doc_id", text: str = "text",
               source: str = "source", buckets: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, source, place, shard, slot.

    Rows of a source are shuffled by a seeded hash of the id and ranked; the
    rank becomes a fraction of the source's rows, shifted by a seeded offset per
    source so that small sources do not all meet at one place; the rows, sorted
    by fraction, are cut into ``n_shards`` ranges whose counts differ by one at
    most.  Each shard then holds each source in its share of the whole, within a
    row or two.  ``slot`` is the gapless place within the shard.

    Null source is a source of its own, null text counts as empty, null ids are
    shuffled like any id.  Repeated rows keep their places; rows equal in id,
    text and source are interchangeable.  An empty table gives no rows; shards
    may be empty when there are fewer rows than shards.  Other columns are
    ignored.

    Both ranks are taken per hash bucket, plus the sizes of the buckets before,
    so that neither a source with most of the rows nor the global order is
    sorted in one task.  Only ids, sources, sizes and checksums are moved.
    """
    spark = docs.sparkSession
    buckets = buckets or power_of_two(spark, 8)
    bits = max(1, buckets.bit_length() - 1)
    value = text_or_empty(text)
    rows = docs.select(
        F.col(id).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_source"),
        (F.octet_length(value) + 1).cast("long").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"),
        hash60(F.lit(seed), F.col(id)).alias("_hash"))
    rows = rows.withColumn("_bucket", F.shiftright("_hash", 60 - bits).cast("int"))
    order = [F.col("_hash"), F.col("_id"), F.col("text_crc32"), F.col("size")]
    ranked = place_in_buckets(rows, ["_source"], "_bucket", order, "_rank")
    offset = hash60(F.lit(seed), F.lit("source"), F.col("_source")) / F.lit(float(1 << 60))
    fraction = (F.col("_rank") + offset) / F.col("_rank_total")
    ranked = staged(ranked.withColumn("_fraction", fraction)
                    .withColumn("_bucket", F.floor(F.col("_fraction") * (1 << bits)).cast("int")), "ranked")
    placed = place_in_buckets(ranked, [], "_bucket", [F.col("_fraction"), F.col("_source"), *order], "place")
    shard = F.expr(f"cast(place * {n_shards} div place_total as int)")
    placed = placed.withColumn("shard", shard)
    slot = F.expr(f"place - (shard * place_total + {n_shards - 1}) div {n_shards}")
    return placed.select(F.col("_id").alias(id), "size", "text_crc32", F.when(F.col("_source") != "", F.expr("substring(_source, 2)")).alias(source),
                         "place", "shard", slot.cast("long").alias("slot"))
