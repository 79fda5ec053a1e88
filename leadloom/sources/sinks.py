"""Exports.  Paths are folders of part files; nothing is gathered in one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom import dictionaries as D
from leadloom.functions import phones as P
from leadloom.functions import text as T
from leadloom.operators.common import one_row

SHEET_ROWS = 1048575  # fixed value: rows of one spreadsheet below its header


def json_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def lead_export(leads: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Canonical column order; every part file opens in a spreadsheet."""
    wanted = [c for c in columns or D.EXPORT_COLUMNS if c in leads.columns]
    leads.select(*wanted).write.mode("overwrite").option("header", "true").option(
        "maxRecordsPerFile", SHEET_ROWS).csv(path)


def rejects_export(rejected: DataFrame, path: str, run_ts: str) -> None:
    """The rejects of one run; a repeated run replaces its own."""
    (rejected.withColumn("run_ts", F.lit(run_ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_ts").parquet(path))


def identity_export(reconciled: DataFrame, path: str) -> None:
    """Mapped, no-phone and no-name identities, one folder each."""
    reconciled.write.mode("overwrite").partitionBy("status").parquet(path)


def bridge_rows(reconciled: DataFrame, file_name: str = "identity_bridge") -> DataFrame:
    """Mapped identities as raw contact rows for the next ingest."""
    return reconciled.filter("status = 'mapped'").select(
        F.lit(file_name).alias("file_name"), F.xxhash64("file_name", "uid").alias("pos"), F.col("uid").alias("raw_uid"),
        F.col("name").alias("raw_name"), F.col("phone").alias("raw_phone"))


def audience(leads: DataFrame, hash_keys: bool = False) -> DataFrame:
    """Upload layout of an ad audience; ``hash_keys`` keeps raw phones and e-mails inside."""
    def key(col: Column) -> Column:
        return F.when(col != "", F.sha2(col, 256)).otherwise("") if hash_keys else col

    phone = P.phone_audience(F.col("phone"))
    return leads.select(
        key(F.coalesce("email", F.lit(""))).alias("email"), key(phone).alias("phone"), T.name_first(F.col("name")).alias("fn"),
        T.name_last(F.col("name")).alias("ln"),
        F.when(F.col("province") == "Unknown", "").otherwise(F.replace("province", F.lit("TP. "), F.lit(""))).alias("ct"),
        F.when(phone != "", "VN").otherwise("").alias("country"), "score", F.col("file_source").alias("source_file"))


def audience_export(leads: DataFrame, path: str, hash_keys: bool = False) -> None:
    audience(leads, hash_keys).write.mode("overwrite").option("header", "true").csv(path)


def sales_list(leads: DataFrame) -> DataFrame:
    return leads.select("score", "name", "phone", "email", "province", "address", F.col("file_source").alias("file_origin"),
                        "lead_key").orderBy(F.desc("score"), "file_origin", "lead_key").drop("lead_key")


def priority_sheets(leads: DataFrame, path: str) -> None:
    """Four sheets of the call list: all, VIP, hot on social, hot in search."""
    cols = ["profile_key", "name", "lead_score", "fb_score", "search_score"]
    rows = leads.select(*cols).persist()
    try:
        for sheet, cond, order in (
            ("all", "true", "lead_score"), ("vip", "lead_score >= 8", "lead_score"),
            ("social", "fb_score > 0", "fb_score"), ("search", "search_score > 0", "search_score"),
        ):
            rows.filter(cond).orderBy(F.desc(order), "profile_key").write.mode("overwrite").option(
                "header", "true").csv(f"{path}/sheet={sheet}")
    finally:
        rows.unpersist()


def cluster_writeback(contacts: DataFrame, clusters: DataFrame, key: str = "lead_key") -> DataFrame:
    """Contacts with the new cluster where one exists, else their old one."""
    new = clusters.select(key, F.col("cluster").alias("_cluster"), F.col("persona").alias("_persona"))
    return (contacts.join(new, key, "left").withColumn("cluster", F.coalesce("_cluster", "cluster"))
            .withColumn("persona", F.coalesce("_persona", "persona")).drop("_cluster", "_persona"))


def snapshot(total: DataFrame, province_counts: DataFrame, at: str) -> DataFrame:
    """One snapshot row: totals, and the province distribution (a fixed short list) as JSON."""
    dist = province_counts.agg(F.to_json(F.sort_array(F.collect_list(F.struct("province", "contacts")))).alias("distribution"))
    return one_row(total, dist).withColumn("snapshot_time", F.lit(at).cast("timestamp"))


def append(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def replace_source(rows: DataFrame, path: str) -> None:
    """Overwrites only the sources present in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
