"""Exact de-duplication by a tree merge of sorted digest runs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.batches import column
from leadloom.llm.common import power_of_two, staged, text_or_empty

KEY = ["_digest", "_length", "_check"]


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", runs: int | None = None, fan_in_bits: int = 3) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting ASCII white space.  The row
    with the most code points stays, then the smallest id (nulls last); of rows
    that are equal in both, exactly one is ``kept``.  Null text counts as empty,
    and all empty texts form one group.  Texts of any length are read whole.  An
    empty table gives an empty result; other columns of ``docs`` are ignored,
    whatever their names.

    Method: a row becomes a digest entry (sha-256 of the normalised text,
    verified by its length and a second hash) in one of ``runs`` runs, chosen by
    a hash of the id, so that a text with any share of the rows is spread over
    all runs.  Each run is sorted and reduced to one entry per digest; in every
    round 2**``fan_in_bits`` neighbouring runs are merged the same way, until one
    run is left, itself partitioned by digest.  The way back goes through the
    first level: the winner is joined to at most one entry per run and digest,
    and from there to rows of the same run.  Only digests move, texts never do.
    """
    return _judged(docs, id, text, runs, fan_in_bits).drop("n_chars")


def _judged(docs: DataFrame, id: str, text: str, runs: int | None = None, fan_in_bits: int = 3) -> DataFrame:
    """``groups`` and the code points of every row's text as n_chars."""
    spark = docs.sparkSession
    runs = runs or power_of_two(spark)
    bits = max(1, runs.bit_length() - 1)
    plain = F.regexp_replace("_text", r"[\x20\x09-\x0D]+", "")
    rows = docs.select(F.col(id).alias("_id"), text_or_empty(text).alias("_text"))
    rows = rows.select("_id", F.char_length("_text").alias("_chars"), F.inline(F.array(F.struct(plain.alias("_plain")))))
    rows = rows.select(
        "_id", "_chars", F.unhex(F.sha2(F.col("_plain"), 256)).alias("_digest"), F.octet_length("_plain").alias("_length"),
        F.xxhash64("_plain").alias("_check"), F.pmod(F.xxhash64("_id"), F.lit(1 << bits)).cast("int").alias("_run"))
    rows = staged(rows, "digests")

    best = F.struct((-F.col("_chars")).alias("chars"), F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"))
    first = rows.groupBy("_run", *KEY).agg(F.min(best).alias("_best"), F.count("*").alias("_size"))
    level, left = first, bits
    while left > 0:
        step = min(fan_in_bits, left)
        left -= step
        level = (level.withColumn("_run", F.shiftright("_run", step)).groupBy("_run", *KEY)
                 .agg(F.min("_best").alias("_best"), F.sum("_size").alias("_size")))
    top = level.select(*KEY, F.col("_best").alias("_winner"), F.col("_size").alias("_total"))

    by_run = first.select("_run", *KEY).join(top, KEY)
    place = F.row_number().over(Window.partitionBy("_run", *KEY).orderBy(F.col("_chars").desc(), F.col("_id").asc_nulls_last()))
    out = rows.withColumn("_place", place).join(by_run, ["_run", *KEY])
    return out.select(
        F.col("_id").alias(id), F.col("_winner.id").alias("keep_id"), F.col("_total").alias("group_size"),
        ((F.col("_place") == 1) & F.col("_id").eqNullSafe(F.col("_winner.id")) & (F.col("_chars") == -F.col("_winner.chars"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"), F.col("_chars").alias("n_chars"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged, whatever their names.

    Of equal texts the row with the most code points stays, then the smallest
    id; of rows that share id and code points too, one stays.  Rows without id are
    judged like others.  Null text counts as empty; texts of any length and empty
    tables are fine.  The rows move once, to the short key of what stays: id,
    digest, code points.
    """
    key = ["i", "no_id", "d", "n"]
    value, digest = text_or_empty(text), F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", ""), 256))
    named = [F.coalesce(column(id).cast("string"), F.lit("")).alias("i"), column(id).isNull().alias("no_id")]
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), *named, digest.alias("d"), F.char_length(value).alias("n"))
    keep = _judged(docs, id, text).filter("kept").select(*named, F.unhex("text_sha256").alias("d"), F.col("n_chars").alias("n"))
    return rows.join(keep, key, "left_semi").dropDuplicates(key).select("row.*")
