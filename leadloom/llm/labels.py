"""Labelled rows for the classifiers: which may be learnt from, all of them or a bounded sample."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import hash60


def remainder(id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sample(labels: DataFrame, id: str, label: str, most: int | None, value: int | None = None) -> DataFrame:
    """Rows (id, label), with ``most`` at most that many in hash order of the id, of one label value or of all; rows without id or label are left out."""
    rows = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("id").isNotNull() & (F.col("label").isNotNull() if value is None else F.col("label") == value))
    return rows if most is None else rows.orderBy(hash60(F.col("id")), "label").limit(most)
